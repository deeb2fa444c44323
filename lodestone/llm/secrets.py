"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

``candidates`` finds every candidate with its place in the whole text. ``ownership``
aggregates candidate hashes by distinct repositories and owners. ``classified`` separates
examples, copied across many owners and many repositories, from owner-specific credentials that
look live: a repository that several owners list (a mirror) is one repository, and its secret stays
live. ``scan`` returns all spans per document; ``redact`` blanks the live ones.

A place is found without a row per match: a text is split at the pattern, and the lengths of
the pieces and of the matches in turn give each match's start in code points. Lists are folded in
blocks of ``BLOCK`` matches, as a fold that appends to one long list copies it at every step.

Base kinds keep their spans whatever the verdict. The method adds spans of kind ``entropy``
(long mixed-case tokens with digits) that are owner-specific; their widely copied
counterparts are counted but not reported.

Here a row's owner is its ``source`` and its repository its ``doc_id``. Defined results: null
text is empty; a null owner or repository counts as one value; repeated rows are rows of
their own but one repository; an empty table gives an empty result; other columns, whatever
their names, pass through ``redact`` unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import carried, checkpointed, column, restored, text_or_empty

#: Kind, quick test, pattern, group whose length decides, least length. Kinds in order of listing.
BASE_KINDS = (
    ("assign", r"(?i)(password|passwd|secret|token|api_?key)", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16}", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24}", r"[0-9a-f]{24,}", 0, 24),
)
#: The method's own kind: tokens of 28 or more with a digit, a small and a capital letter within.
ADDED = ("entropy", r"[A-Za-z0-9+/_-]{28}", r"[A-Za-z0-9+/_-]{28,}", 0, 28)
KINDS = (*[k[0] for k in BASE_KINDS], ADDED[0])
#: A candidate that so many owners and so many repositories have is an example; else it is owner-specific.
EXAMPLE_OWNERS, EXAMPLE_REPOS = 3, 3
#: Matches that are folded at a time (time, not results).
BLOCK = 256
REDACTED = "[SECRET]"
SPAN = "array<struct<start:bigint,kind_no:int,end:bigint,hash:bigint>>"


def _in_blocks(items: Column) -> Column:
    """An array as an array of blocks."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(items) / BLOCK).cast("int") - 1, F.lit(0))), lambda b: F.slice(items, b * BLOCK + 1, BLOCK))


def _bound(value: Column, use) -> Column:
    """``use(value)``, with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _matches(text: Column, quick: str, pattern: str, group: int, least: int, kind_no: int) -> Column:
    """Spans of a pattern's leftmost matches that do not overlap, from the whole text."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # A text of n matches splits into n + 1 pieces, so the two lists are walked together.
    deciding = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    rows = F.arrays_zip(F.split(text, pattern).alias("piece"), whole.alias("match"), deciding.alias("part"))
    none = F.expr(f"cast(array() as {SPAN})")
    size = lambda z: (F.length(z["piece"]) + F.coalesce(F.length(z["match"]), F.lit(0))).cast("long")

    def step(acc, z):
        end = acc["at"] + size(z)
        begin = (acc["at"] + F.length(z["piece"])).cast("long")
        span = F.struct(begin.alias("start"), F.lit(kind_no).alias("kind_no"), end.alias("end"), F.xxhash64(z["part"]).alias("hash"))
        keep = F.length(z["part"]) >= least
        if kind_no == len(BASE_KINDS):
            keep = keep & z["part"].rlike("[0-9]") & z["part"].rlike("[a-z]") & z["part"].rlike("[A-Z]")
        return F.struct(end.alias("at"), F.when(keep, F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    def block(acc, z):
        spans = F.aggregate(z, F.struct(acc["at"].alias("at"), none.alias("spans")), step)["spans"]
        return F.struct(F.aggregate(z, acc["at"], lambda at, x: at + size(x)).alias("at"), F.array_append(acc["blocks"], spans).alias("blocks"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr(f"cast(array() as array<{SPAN}>)").alias("blocks"))
    spans = _bound(rows, lambda r: F.flatten(F.aggregate(_in_blocks(r), start, block)["blocks"]))
    return F.when(text.rlike(quick), spans).otherwise(none)


def candidates(text: Column) -> Column:
    """All candidate spans of a text by start, then kind as listed."""
    found = [_matches(text, quick, pattern, group, least, i) for i, (_, quick, pattern, group, least) in enumerate((*BASE_KINDS, ADDED))]
    return F.sort_array(F.concat(*found))


def ownership(rows: DataFrame) -> DataFrame:
    """(hash, n_repos, n_owners) from (hash, owner, repo), each counted by its distinct values.

    A row goes once as an owner and once as a repository. First they are made distinct, then
    counted; each step reduces on the map side, so a hash that every row holds sends a row a task
    and value. Nulls count as one value.
    """
    named = F.explode(F.array(F.struct(F.lit(True).alias("is_owner"), column(rows, "owner").cast("string").alias("name")), F.struct(F.lit(False).alias("is_owner"), column(rows, "repo").cast("string").alias("name"))))
    one = rows.select("hash", named.alias("v")).groupBy("hash", "v.is_owner", "v.name").agg(F.lit(1).alias("one"))
    return one.groupBy("hash").agg(F.sum(F.when(F.col("is_owner"), 0).otherwise(1)).alias("n_repos"), F.sum(F.when(F.col("is_owner"), 1).otherwise(0)).alias("n_owners"))


def _is_live(example_owners: int, example_repos: int) -> Column:
    return ~((F.col("n_owners") >= example_owners) & (F.col("n_repos") >= example_repos))


def classified(docs: DataFrame, example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS) -> DataFrame:
    """Per row of ``docs``: doc_id, spans with verdicts (start, kind_no, end, hash, n_repos, n_owners, live).

    Texts are scanned once; what follows reads the checkpointed spans. Rows without candidates
    take no part in the join. A candidate that a third of all rows hold makes a skewed join
    key, which adaptive execution splits, as both sides are read from checkpoints.
    """
    scanned = docs.select("doc_id", F.col("source").cast("string").alias("owner"), candidates(text_or_empty("text")).alias("spans"))
    found = checkpointed(scanned.withColumn("row", F.monotonically_increasing_id()))
    verdict = "array<struct<start:bigint,kind_no:int,end:bigint,hash:bigint,n_repos:bigint,n_owners:bigint,live:boolean>>"
    none = found.filter(F.size("spans") == 0).select("doc_id", F.expr(f"cast(array() as {verdict})").alias("spans"))
    each = found.filter(F.size("spans") > 0).select("row", "owner", F.col("doc_id").alias("repo"), F.explode("spans").alias("span")).select("row", "owner", "repo", "span", F.col("span.hash").alias("hash"))
    stats = checkpointed(ownership(each))
    joined = each.join(stats, "hash")
    judged = F.struct("span.start", "span.kind_no", "span.end", "hash", "n_repos", "n_owners", _is_live(example_owners, example_repos).alias("live"))
    by_row = joined.groupBy("row").agg(F.sort_array(F.collect_list(judged)).alias("spans"))
    some = found.filter(F.size("spans") > 0).select("row", "doc_id").join(by_row, "row").select("doc_id", "spans")
    return none.unionByName(some)


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind_no"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of_kind(kind_no: int):
    return lambda s: s["kind_no"] == kind_no


def scan(docs: DataFrame, example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS) -> DataFrame:
    """Counts of the base kinds, a digest of the base spans, all spans, and the two verdicts' counts."""
    rows = classified(docs, example_owners, example_repos)
    base = F.filter("spans", lambda s: s["kind_no"] < len(BASE_KINDS))
    reported = F.filter("spans", lambda s: (s["kind_no"] < len(BASE_KINDS)) | s["live"])
    count = lambda keep: F.size(F.filter("spans", keep)).cast("long")
    return rows.select(
        "doc_id",
        *[count(_of_kind(i)).alias(f"n_{k[0]}") for i, k in enumerate(BASE_KINDS)],
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(reported).alias("spans"),
        count(lambda s: s["live"]).alias("n_live"),
        count(lambda s: ~s["live"]).alias("n_example"),
    )


def _blanked(text: Column, live: Column, mark: str) -> Column:
    """``text`` with its live spans (ascending) replaced; overlapping ones (a token inside an assignment) merge.

    A block's spans cut the block's own part of the text, which is cut from the text once.
    """
    empty = F.expr("cast(array() as array<string>)")

    def block(acc, spans):
        end = F.greatest(acc["at"], F.array_max(F.transform(spans, lambda s: s["end"])))
        part = F.substr(text, (acc["at"] + 1).cast("int"), (end - acc["at"]).cast("int"))

        def cut(part):
            def step(a, s):
                piece = F.substr(part, (a["at"] - acc["at"] + 1).cast("int"), F.greatest(s["start"] - a["at"], F.lit(0)).cast("int"))
                fresh = F.when(s["start"] >= a["at"], F.concat(a["out"], F.array(piece, F.lit(mark)))).otherwise(a["out"])
                return F.struct(F.greatest(a["at"], s["end"]).cast("long").alias("at"), fresh.alias("out"))

            return F.array_join(F.aggregate(spans, F.struct(acc["at"].alias("at"), empty.alias("out")), step)["out"], "")

        return F.struct(end.cast("long").alias("at"), F.array_append(acc["out"], _bound(part, cut)).alias("out"))

    folded = F.aggregate(_in_blocks(live), F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out")), block)
    return _bound(folded, lambda f: F.concat(F.array_join(f["out"], ""), F.substr(text, (f["at"] + 1).cast("int"))))


def redact(docs: DataFrame, example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS, mark: str = REDACTED) -> DataFrame:
    """``docs`` with every live span's text replaced by ``mark``; examples and clean rows stay as they are.

    Only rows that pass a kind's quick test are checkpointed with their candidates; the rest of
    the corpus is never written or shuffled here. The verdicts come back by hash alone, to those few rows.
    """
    names = docs.columns
    text = text_or_empty("text")
    may_hold = F.lit(False)
    for _, quick, *_ in (*BASE_KINDS, ADDED):
        may_hold = may_hold | text.rlike(quick)
    rows = docs.select(column(docs, "doc_id").alias("doc_id"), column(docs, "source").cast("string").alias("owner"), column(docs, "text").cast("string").alias("text"), carried(docs))
    clean = rows.filter(~may_hold).select(*restored(names))
    held = checkpointed(rows.filter(may_hold).select(F.col("doc_id").alias("repo"), "owner", "_row", candidates(text).alias("spans")).withColumn("row", F.monotonically_increasing_id()))
    each = held.select("row", "owner", "repo", F.explode("spans").alias("span")).select("row", "owner", "repo", "span", F.col("span.hash").alias("hash"))
    live = each.join(checkpointed(ownership(each)), "hash").filter(_is_live(example_owners, example_repos))
    by_row = live.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("span.start", "span.end"))).alias("live"))
    whole = F.col("_row").getField("text").cast("string")
    new_text = F.when(F.col("live").isNull(), whole).otherwise(_blanked(whole, F.col("live"), mark))
    marked = held.join(by_row, "row", "left").withColumn("_row", F.col("_row").withField("text", new_text))
    return clean.unionByName(marked.select(*restored(names)))
