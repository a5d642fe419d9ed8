"""Secret scanning with multipart credential linking (native expressions only).

Strong kinds (``assign``, ``access``, ``hex``) are always reported.  Weak candidates are
reported only if the parts that complete them stand within ``scope`` code points:

* ``secret``: a bare run of exactly 40 key characters, near an identifier;
* ``user``: ``user = name`` and the like, near a secret;
* ``endpoint``: a URL, near both an identifier and a secret.

Identifiers are ``access`` and ``user`` spans, secrets are ``assign``, ``hex`` and
``secret`` spans.  The linking is an interval join over bins as wide as the scope.  Of each
role only the first start and the last end in a bin are kept, which is enough to decide
"one within the scope" and keeps a document full of parts from making pairs.  Weak spans
that overlap a strong one are dropped.

Positions come from running sums over the lengths of matches and of what stands between
them, in windows of one row's matches of one kind, so the work grows with the number of
matches; only their lengths are shuffled, never texts.

Defined cases: a null or empty text has no spans; every row is a document of its own, so
rows equal in id and text get equal results; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

# The base patterns of the scan, with the group whose length counts and the least length.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
STRONG = {
    "assign": (ASSIGN, 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    # runs are maximal, so asking for 24 characters finds what dropping shorter runs leaves
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
# The weak candidates.
WEAK = {
    "secret": (r"(?<![A-Za-z0-9/+])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+])", 0, 40),
    "user": (r"""(?i:user(?:name)?|login|account|client_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]+)""", 1, 3),
    "endpoint": (r"https?://[A-Za-z0-9][A-Za-z0-9.:/_-]+", 0, 12),
}
KINDS = [*STRONG, *WEAK]
ROLE = {"access": "identifier", "user": "identifier", "assign": "secret", "hex": "secret", "secret": "secret"}
SPANS = "array<struct<start:int,rank:int,end:int>>"
MATCHES = "array<struct<rank:int,gap:int,size:int,keep:boolean>>"


def found(text: Column, kind: str, spec: tuple[str, int, int]) -> Column:
    """The kind's matches, leftmost and non-overlapping: its rank, the code points before
    each match since the last one, the match's own, and whether it is long enough.

    ``split`` and ``regexp_extract_all`` walk the same matches.
    """
    pattern, group, least = spec
    lengths = lambda group: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda x: F.length(x))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    steps = F.arrays_zip(gaps.alias("gap"), lengths(0).alias("size"), lengths(group).alias("inner"))
    steps = F.slice(steps, 1, F.size(steps) - 1)  # after the last match comes the rest of the text
    matches = F.transform(steps, lambda x: F.struct(F.lit(KINDS.index(kind)).alias("rank"), x["gap"].alias("gap"), x["size"].alias("size"), (x["inner"] >= least).alias("keep")))
    return F.when(text.rlike(pattern), matches).otherwise(F.array().cast(MATCHES))


def placed(matches: DataFrame) -> DataFrame:
    """(row, start, rank, end) in code points from (row, matches)."""
    each = matches.select("row", F.posexplode("matches").alias("pos", "m")).select("row", "pos", "m.*")
    walked = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("row", "rank").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    spans = each.withColumn("end", walked.cast("int")).where("keep")
    return spans.select("row", (F.col("end") - F.col("size")).alias("start"), "rank", "end")


def apart(spans: DataFrame) -> DataFrame:
    """``spans`` without the weak ones that overlap a strong one of their row."""
    strong = F.col("rank") < len(STRONG)
    by_start = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    by_end = Window.partitionBy("row").orderBy(F.desc("end")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # a strong span that starts no later and ends after the start, or ends no earlier and starts before the end
    reach = F.max(F.when(strong, F.col("end"))).over(by_start)
    low = F.min(F.when(strong, F.col("start"))).over(by_end)
    inner = F.max(F.when(strong, F.col("start"))).over(Window.partitionBy("row").orderBy("end").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    marked = spans.withColumn("reach", reach).withColumn("low", low).withColumn("inner", inner)
    clear = F.coalesce(F.col("reach") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("low") >= F.col("end"), F.lit(True)) & F.coalesce(F.col("inner") < F.col("start"), F.lit(True))
    return marked.where(strong | clear).select("row", "start", "rank", "end")


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    parts = F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(parts, ",")


def linked(parts: DataFrame, scope: int) -> DataFrame:
    """The weak spans (row, start, rank, end) whose complements are in reach, of ``parts`` of the same columns."""
    rank = {k: KINDS.index(k) for k in KINDS}
    role = F.lit(None).cast("string")
    for kind, name in ROLE.items():
        role = F.when(F.col("rank") == rank[kind], name).otherwise(role)
    weak = parts.where(F.col("rank") >= len(STRONG))
    by_bin = parts.withColumn("role", role).where("role is not null").select("row", "role", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor(F.col("end") / scope))).alias("bin"))
    held = by_bin.groupBy("row", "role", "bin").agg(F.min("start").alias("first_start"), F.max("end").alias("last_end"))
    asks = weak.select("*", F.explode(F.sequence(F.floor(F.col("start") / scope) - 1, F.floor(F.col("end") / scope) + 1)).alias("bin"))
    near = (F.col("last_end") >= F.col("start") - scope) & (F.col("first_start") <= F.col("end") + scope)
    met = asks.join(held, ["row", "bin"]).where(near)
    flag = lambda name: F.max(F.col("role") == name).alias(name)
    met = met.groupBy("row", "start", "rank", "end").agg(flag("identifier"), flag("secret"))
    enough = (
        F.when(F.col("rank") == rank["secret"], F.col("identifier"))
        .when(F.col("rank") == rank["user"], F.col("secret"))
        .otherwise(F.col("identifier") & F.col("secret"))
    )
    return met.where(enough).select("row", "start", "rank", "end")


def scan_secrets(docs: DataFrame, scope: int = 400) -> DataFrame:
    """doc_id, strong and linked: arrays of (start, rank in KINDS, end), a row for each row of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    scratch = Scratch(docs.sparkSession, "secrets")
    matches = F.concat(*[found(F.col("text"), k, v) for k, v in {**STRONG, **WEAK}.items()]).alias("matches")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = scratch.write(rows.select("row", "doc_id", matches), "matches")  # the written number is the row's name from here on
    spans = scratch.write(placed(rows.where(F.size("matches") > 0).select("row", "matches")), "spans")
    # a document without weak spans has nothing to link
    asking = spans.where(F.col("rank") >= len(STRONG)).select("row").distinct()
    parts = scratch.write(apart(spans.join(asking, "row", "left_semi")), "parts")
    listed = lambda df, name: df.groupBy("row").agg(F.collect_list(F.struct("start", "rank", "end")).alias(name))
    strong, more = listed(spans.where(F.col("rank") < len(STRONG)), "strong"), listed(linked(parts, scope), "linked")
    none = lambda name: F.coalesce(name, F.array().cast(SPANS)).alias(name)
    return rows.select("row", "doc_id").join(strong, "row", "left").join(more, "row", "left").select("doc_id", none("strong"), none("linked"))
