"""Secret scan with corpus-wide ownership frequency.

Patterns propose candidates in every text.  The value of each candidate is hashed, and the
corpus tells in how many distinct repositories of how many distinct owners that hash occurs.
A value that several owners have is a copied example; one that stays with its owner looks
like a live credential.  Candidates of the fixed kinds are always reported; looser ones, for
which no word or prefix vouches, only when they look live and no fixed span covers them.

All work is DataFrame expressions.  Texts are read once; what moves is positions and hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitfactors.functions.scale import stable
from pitfactors.llm.common import lookup, short_hash, whole


def any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: Fixed kinds: name, pattern, group that holds the value.  Runs of one class are matched as a
#: whole by ``+`` and ``{n,}`` alike, so the least length can stand in the pattern.
BASE = (
    ("assign", "(" + "|".join(any_case(w) for w in ("password", "passwd", "secret", "token", "api_?key")) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2),
    ("access", r"AKIA[A-Z0-9]{12,}", 0),
    ("hex", r"[0-9a-f]{32,}", 0),
)
#: Kinds of the method: private key blocks, and runs of letters and digits that look random.
EXTRA = (
    ("pem", r"-----BEGIN [A-Z0-9\x20]*PRIVATE KEY-----[A-Za-z0-9+/=\x20\x09-\x0D]+", 0),
    ("random", r"[A-Za-z0-9_-]{20,}", 0),
)
KINDS = tuple(k for k, _, _ in BASE + EXTRA)


@dataclass(frozen=True)
class Ownership:
    wide_owners: int = 3  # a value that so many owners have is a copied example
    assign_chars: int = 8  # least length of an assigned value
    turns: int = 4  # least changes between letter and digit in a random-looking run
    variety: int = 10  # least distinct characters in it


def _found(text: str, kind: str, pattern: str, group: int, rule: Ownership) -> Column:
    """Matches of one kind in order: kind, n, gap (characters since the match before), size, value hash, and whether it passes."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    pieces = F.arrays_zip(matches.alias("hit"), values.alias("value"), F.slice(F.split(text, pattern, -1), 1, F.size(matches)).alias("gap"))

    def one(x: Column, i: Column) -> Column:
        passes = F.lit(True)
        if kind == "assign":
            passes = F.length(x["value"]) >= rule.assign_chars
        if kind == "random":
            turns = F.regexp_count(x["value"], F.lit("[0-9][A-Za-z]")) + F.regexp_count(x["value"], F.lit("[A-Za-z][0-9]"))
            passes = (turns >= rule.turns) & (F.size(F.array_distinct(F.split(x["value"], ""))) >= rule.variety)
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), i.alias("n"), F.length(x["gap"]).cast("long").alias("gap"), F.length(x["hit"]).cast("long").alias("size"),
            short_hash(x["value"]).alias("hash"), passes.alias("passes"),
        )

    empty = F.array().cast("array<struct<kind:int,n:int,gap:bigint,size:bigint,hash:binary,passes:boolean>>")
    return F.when(F.regexp_like(text, F.lit(pattern)), F.transform(pieces, one)).otherwise(empty)


def candidates(docs: DataFrame, rule: Ownership, id_col: str, text_col: str, owner_col: str, repo_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): every input row under a row number, and its passing candidates with start and end in code points."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("full"), F.col(owner_col).cast("string").alias("owner"), F.col(repo_col).cast("string").alias("repo"))
    found = F.concat(*[_found("full", *kind, rule) for kind in BASE + EXTRA])
    rows = stable(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "owner", "repo", found.alias("found")))
    each = rows.where(F.size("found") > 0).select("row", "owner", "repo", F.explode("found").alias("f")).select("row", "owner", "repo", "f.*")
    before = Window.partitionBy("row", "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(before))
    spans = each.where("passes").select("row", "owner", "repo", "kind", (F.col("end") - F.col("size")).alias("start"), "end", "hash")
    return rows.select("row", "doc_id"), spans


def ownership(spans: DataFrame) -> DataFrame:
    """Distinct repositories and owners of each value: hash, repos, owners.  An unknown owner or repository counts as one."""
    once = spans.select("hash", "owner", "repo").distinct()  # a value in every text is spread over its repositories
    held = once.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"))
    return held.groupBy("hash").agg(F.sum("repos").alias("repos"), F.count(F.lit(1)).alias("owners"))


def _uncovered(spans: DataFrame) -> DataFrame:
    """Fixed spans, and those of the method's that share no character with a fixed span of their row."""
    fixed = F.col("kind") < len(BASE)
    up = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("row").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0)
    reach = F.coalesce(F.max(F.when(fixed, F.col("end"))).over(up), F.lit(0))
    following = F.min(F.when(fixed, F.col("start"))).over(down)
    spans = spans.withColumn("reach", reach).withColumn("following", following)
    clear = (F.col("reach") <= F.col("start")) & (F.col("following").isNull() | (F.col("following") >= F.col("end")))
    return spans.where(fixed | clear).drop("reach", "following")


def find(docs: DataFrame, rule: Ownership = Ownership(), id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(rows, spans): every input row, and its reported spans with row, kind, start, end, hash, repos, owners, live.

    * A null text is empty and has no spans; texts are read whole, whatever their length.
    * Matches of one kind are leftmost and do not overlap; those too short are dropped, and the
      search goes on behind them.  Kinds are independent and may overlap.
    * ``live`` is true where fewer than ``wide_owners`` owners have the value.  A null owner is
      one owner, a null repository one repository.  Repeated rows are rows of their own, but
      count once as repository.
    * Other columns are ignored; an empty table gives no rows.
    """
    rows, spans = candidates(docs, rule, id_col, text_col, owner_col, repo_col)
    spans = stable(spans)
    judged = lookup(spans.drop("owner", "repo"), stable(ownership(spans)), "hash")
    judged = judged.withColumn("live", F.col("owners") < rule.wide_owners)
    return rows, _uncovered(judged.where((F.col("kind") < len(BASE)) | F.col("live")))


def digest(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """One row per input row: doc_id, numbers of fixed spans, base_sha256, spans, n_live, n_copied."""
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    text = F.concat_ws(":", kind, F.col("start").cast("string"), F.col("end").cast("string"))
    found = spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", text.alias("text"), "live"))).alias("all"))
    out = rows.join(found, "row", "left").withColumn("all", F.coalesce("all", F.array().cast("array<struct<start:bigint,kind:int,text:string,live:boolean>>")))

    def number(test) -> Column:
        return F.size(F.filter("all", test)).cast("long")

    def joined(items: Column) -> Column:
        return F.array_join(F.transform(items, lambda x: x["text"]), ",")

    def of_kind(k: int):
        return lambda x: x["kind"] == k

    counts = [number(of_kind(k)).alias(f"n_{name}") for k, (name, _, _) in enumerate(BASE)]
    base = joined(F.filter("all", lambda x: x["kind"] < len(BASE)))
    return out.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), joined(F.col("all")).alias("spans"), number(lambda x: x["live"]).alias("n_live"), number(lambda x: ~x["live"]).alias("n_copied"))
