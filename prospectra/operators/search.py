"""Text search over a stored token table.

The table (token, id) is range-partitioned and sorted by token, so a prefix is a range of
tokens that the Parquet statistics turn into few row groups. How often each token occurs
is stored beside it: a query reads its rarest word first, and each further word only cuts
the ids that are left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .joins import query_tokens, search_tokens

#: Follows every token of letters and digits that begins with what stands before it.
AFTER = "{"
#: Bytes of a row group of the token table.
ROW_GROUP = 8 << 20


def prefix_range(prefix: str, token: str = "token") -> Column:
    """Tokens of a-z and 0-9 that begin with ``prefix``, as bounds that reach a scan."""
    return (F.col(token) >= prefix) & (F.col(token) < prefix + AFTER)


class TokenIndex:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, leads: DataFrame, fields=("name", "category", "city", "address")) -> None:
        """Index the leads' words; replaces what is there. A very common word's rows are
        spread by id over several partitions."""
        tokens = search_tokens(leads, fields).repartitionByRange("token", "id").sortWithinPartitions("token", "id")
        tokens.write.mode("overwrite").option("parquet.block.size", ROW_GROUP).parquet(f"{self.path}/tokens")
        counts = self.tokens().groupBy("token").agg(F.count("*").alias("n"))
        counts.repartitionByRange("token").sortWithinPartitions("token").write.mode("overwrite").parquet(f"{self.path}/counts")

    def tokens(self) -> DataFrame:
        return self.spark.read.schema("id string, token string").parquet(f"{self.path}/tokens")

    def frequencies(self, words: list[str]) -> dict[str, int]:
        """How many rows of the token table each prefix has; one row of sums comes back."""
        counts = self.spark.read.schema("token string, n long").parquet(f"{self.path}/counts")
        near = prefix_range(words[0])
        for w in words[1:]:
            near |= prefix_range(w)
        row = counts.filter(near).agg(*[F.coalesce(F.sum(F.when(prefix_range(w), F.col("n"))), F.lit(0)).alias(f"n{k}") for k, w in enumerate(words)]).first()
        return {w: row[k] for k, w in enumerate(words)}

    def ids(self, q: str) -> DataFrame | None:
        """(id): leads in which each word of the query begins a word, or None for a query
        without a word, which all leads answer."""
        words = list(dict.fromkeys(query_tokens(q)))
        if not words:
            return None
        n = self.frequencies(words)
        hits = None
        for w in sorted(words, key=lambda w: (n[w], w)):
            rows = self.tokens().filter(prefix_range(w)).select("id")
            hits = (rows if hits is None else rows.join(hits, "id", "left_semi")).distinct()
        return hits

    def search(self, leads: DataFrame, q: str) -> DataFrame:
        """joins.search() of the indexed leads, from the index."""
        found = self.ids(q)
        return leads if found is None else leads.join(found, "id", "left_semi")
