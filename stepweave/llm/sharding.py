"""Weighted rendezvous hashing of record keys over shards.

A record goes to the shard with the largest -weight / ln(u), u a hash of key and shard in (0, 1). Each shard gets its
share of weight, and a change of shards moves only the records that the changed shards win or lose. One
narrow projection: no shuffle, no state, the same on every machine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.llm.common import table

#: Shard number and weight: the last four machines are twice as large.
SHARDS = {i: 2.0 if i >= 12 else 1.0 for i in range(16)}
ADDED = {16: 2.0}


def score(key: Column, shard: int, weight: float) -> Column:
    digest = F.md5(F.concat(key, F.lit(f":{shard}")))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return F.lit(-float(weight)) / F.ln(u)


def shard_of(key: Column, shards: dict[int, float]) -> Column:
    """The shard of a key; the smaller number wins a tie. A null key counts as the empty string, so all records without a
    key share a shard. Weights are positive."""
    if not shards or any(w <= 0 for w in shards.values()):
        raise ValueError("shards need positive weights")
    text = F.coalesce(key.cast("string"), F.lit(""))
    best = [F.struct(score(text, s, w).alias("score"), F.lit(-s).alias("s")) for s, w in sorted(shards.items())]
    return (-(F.greatest(*best) if len(best) > 1 else best[0])["s"]).cast("int")


def assign(df: DataFrame, key: str, shards: dict[int, float], name: str = "shard") -> DataFrame:
    """df with its rows' shard in column name, replaced if there is one. Equal keys share a shard; no row is dropped."""
    return df.withColumn(name, shard_of(F.col(key), shards))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's shard before and after a shard joins."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    both = docs.select("doc_id", shard_of(F.col("doc_id"), SHARDS).alias("shard"), shard_of(F.col("doc_id"), SHARDS | ADDED).alias("next_shard"))
    return both.withColumn("moved", F.col("shard") != F.col("next_shard"))


def _best(shards: dict[int, float]) -> str:
    rows = ", ".join(f"({s}, {w!r})" for s, w in shards.items())
    u = "(('0x' || substr(md5(k || ':' || s), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0"
    return f"SELECT k, arg_max(s, (-w::DOUBLE / ln({u}), -s)) AS shard FROM (SELECT DISTINCT coalesce(doc_id::VARCHAR, '') AS k FROM documents), (VALUES {rows}) t(s, w) GROUP BY k"


OP4_SQL = f"""
WITH a AS ({_best(SHARDS)}), b AS ({_best(SHARDS | ADDED)})
SELECT doc_id, a.shard::INTEGER AS shard, b.shard::INTEGER AS next_shard, a.shard <> b.shard AS moved
FROM documents JOIN a ON a.k = coalesce(doc_id::VARCHAR, '') JOIN b ON b.k = a.k
"""
