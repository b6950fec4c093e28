"""Secret scan with corpus-wide ownership frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_or_empty

# Kind, pattern, group that holds the value, least length of that value. The
# last kind is this method's own: long mixed tokens outside the other spans.
KINDS = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|"""
               r"""[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),  # the runs of 20 and more, as shorter ones are dropped
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
OWNED = ("owned", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}", 0, 20)


def _located(name: str, text: Column, pattern: str, group: int) -> Column:
    """Matches with the text before each: the pieces between matches give the places."""
    hit = text.rlike(pattern)
    return F.when(hit, F.arrays_zip(
        F.split(text, pattern, -1).alias("before"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"))).alias(name)


def _spans(found: Column, kind: str, rank: int, least: int) -> Column:
    """Spans in code points, from the pieces and matches of one kind."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast(
        "array<struct<start:int,rank:int,end:int,kind:string,value:string>>").alias("spans"))

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + F.length(x["before"])
        end = begin + F.length(x["match"])
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"),
                        x["value"].alias("value"))
        keep = x["match"].isNotNull() & (F.length(x["value"]) >= least)
        return F.struct(F.coalesce(end, begin).alias("at"),
                        F.when(keep, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    spans = F.aggregate(found, start, step)["spans"]
    return F.coalesce(spans, start["spans"])


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                 s["end"].cast("string"))), ",")


def secret_spans(docs: DataFrame, owner: str = "source", repository: str = "doc_id", many_owners: int = 3) -> DataFrame:
    """Secrets of every document and whether each is owner-specific or widely copied.

    One row per row of `docs`: doc_id, n_assign, n_access, n_hex, base_sha256 (digest of
    the pattern spans), spans (these and the added ones), n_owned, n_live, n_copied.

    Candidates are the pattern matches and, beside them, long tokens that mix letters
    and digits. The value of each is counted over the whole corpus by distinct owners and
    distinct repositories. A value of `many_owners` owners or more is a copied example, any
    other is live-looking. Live-looking tokens outside all pattern spans become spans of
    kind "owned"; pattern spans always stay. n_live and n_copied count the spans (added
    and dropped candidates included) by that class.

    Null texts are empty; a null owner or repository counts as one of its own; documents
    without findings get zeros and empty strings; repeated rows are kept, and being equal
    they add neither owners nor repositories; further columns are left out.
    """
    patterns = [*KINDS, OWNED]
    texts = docs.select("doc_id", F.col(owner).alias("owner"), F.col(repository).alias("repository"),
                        text_or_empty().alias("text"))
    located = texts.select("doc_id", "owner", "repository",
                           *[_located(kind, F.col("text"), pattern, group) for kind, pattern, group, _ in patterns])
    found = located.select(
        "doc_id", "owner", "repository", F.monotonically_increasing_id().alias("row"),
        F.array_sort(F.concat(*[_spans(F.col(kind), kind, i, least) for i, (kind, _, _, least) in
                                enumerate(KINDS)])).alias("base"),
        _spans(F.col(OWNED[0]), OWNED[0], len(KINDS), OWNED[3]).alias("loose"))
    apart = F.filter("loose", lambda x: ~F.exists("base", lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])))
    found = stored(found.withColumn("loose", apart), "secrets")

    candidates = found.filter((F.size("base") > 0) | (F.size("loose") > 0)).select(
        "row", "owner", "repository", F.explode(F.concat("base", "loose")).alias("span"))
    candidates = candidates.withColumn("hash", F.sha2(F.col("span.value"), 256))
    # distinct per owner and repository first, which combines before the shuffle; then a row per value
    blank = F.lit("\x00null")
    owners = (candidates.groupBy("hash", F.coalesce(F.col("owner").cast("string"), blank).alias("owner"),
                                 F.coalesce(F.col("repository").cast("string"), blank).alias("repository"))
              .agg(F.count("*").alias("n")).groupBy("hash", "owner").agg(F.count("*").alias("repositories"))
              .groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("repositories").alias("n_repositories")))
    # a copied example may be in a third of all documents: its class is met in several salted groups
    salts = 8
    classes = owners.select("hash", (F.col("n_owners") >= many_owners).alias("copied"),
                            F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    judged = candidates.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int")).join(
        classes, ["hash", "salt"])
    added = (F.col("span.kind") == OWNED[0]) & ~F.col("copied")
    per_row = judged.groupBy("row").agg(
        F.sum(F.col("copied").cast("long")).alias("n_copied"), F.count("*").alias("n"),
        F.array_sort(F.collect_list(F.when(added, F.col("span")))).alias("owned"))
    out = found.join(per_row, "row", "left")
    owned = F.coalesce("owned", F.slice("base", 1, 0))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    copied = F.coalesce("n_copied", F.lit(0))
    return out.select(
        "doc_id", *[count(k[0]) for k in KINDS], F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
        _written(F.array_sort(F.concat("base", owned))).alias("spans"), F.size(owned).cast("long").alias("n_owned"),
        (F.coalesce("n", F.lit(0)) - copied).alias("n_live"), copied.alias("n_copied"))
