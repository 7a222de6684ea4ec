"""Key to row look-ups."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinworks.functions.hashes import md4_hex
from skeinworks.operators.rows import ROW
from skeinworks.session import quoted


def last_row_by(df: DataFrame, *keys: str) -> DataFrame:
    """Key to row number; of equal keys the last row wins."""
    return df.groupBy(*[quoted(k) for k in keys]).agg(F.max(ROW).alias(ROW))


def first_row_by(df: DataFrame, *keys: str) -> DataFrame:
    """Key to row number; of equal keys the first row wins."""
    return df.groupBy(*[quoted(k) for k in keys]).agg(F.min(ROW).alias(ROW))


def digest_row_by(df: DataFrame, *keys: str) -> DataFrame:
    """MD4 of the key list's text to row number, last row wins.  Digests are made of distinct keys only."""
    by = last_row_by(df, *keys)
    text = F.concat(F.lit("["), F.concat_ws(", ", *[F.coalesce(quoted(k).cast("string"), F.lit("null")) for k in keys]), F.lit("]"))
    return by.select(md4_hex(text).alias("digest"), ROW)


def trie_paths(df: DataFrame, *keys: str) -> DataFrame:
    """Paths of the keys' texts to row number, the first kept (``path``, ``__row``)."""
    path = F.array(*[F.coalesce(quoted(k).cast("string"), F.lit("null")) for k in keys])
    return df.groupBy(path.alias("path")).agg(F.min(ROW).alias(ROW))


def trie_leaves(paths: DataFrame) -> DataFrame:
    """Paths that are no beginning of a longer one: what exact look-up finds."""
    longer = paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("path") - 1, F.lit(1))), lambda n: F.slice("path", 1, n))).alias("path"), F.size("path").alias("n")).where("size(path) < n").select("path").distinct()
    return paths.join(longer, "path", "left_anti")


def trie_find(paths: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The entry of exactly this path."""
    return paths.where(F.col("path") == F.array(*[F.lit(w) for w in wanted]))


def trie_prefix(paths: DataFrame, prefix: Sequence[str]) -> DataFrame:
    """All entries below a path."""
    return paths.where(F.slice("path", 1, len(prefix)) == F.array(*[F.lit(w) for w in prefix]))


#: Largest filter that is built and sent: 8 MB, the bound Spark itself sets to such filters.
MOST_BITS = 1 << 26


@dataclass(frozen=True)
class Bloom:
    """A Bloom filter: built by aggregation over all partitions, asked by a JVM expression."""

    raw: bytes

    def may_contain(self, column: Column) -> Column:
        """A boolean column: may the value be in the filter?  Never false for one that was added; false for null."""
        return column.isNotNull() & _jvm_column("BloomFilterMightContain", F.lit(self.raw), F.xxhash64(column))

    def merged(self, other: Bloom) -> Bloom:
        """The union of two filters of equal size and hash count."""
        jvm = SparkSession.active()._jvm
        a, b = (jvm.org.apache.spark.util.sketch.BloomFilter.readFrom(jvm.java.io.ByteArrayInputStream(x.raw)) for x in (self, other))
        if not a.isCompatible(b):
            raise ValueError("filters of different size or hash count")
        out = jvm.java.io.ByteArrayOutputStream()
        a.mergeInPlace(b).writeTo(out)
        return Bloom(bytes(out.toByteArray()))


def _jvm_column(name: str, *children: Column, aggregate: bool = False) -> Column:
    """A Catalyst expression that has no function of its own."""
    from pyspark.sql.classic.column import Column as Classic

    jvm = SparkSession.active()._jvm
    wrap, package = jvm.org.apache.spark.sql.classic.ExpressionUtils, jvm.org.apache.spark.sql.catalyst.expressions
    made = getattr(package.aggregate if aggregate else package, name)(*[wrap.expression(c._jc) for c in children])
    return Classic(wrap.column(made.toAggregateExpression() if aggregate else made))


def bloom_filter(df: DataFrame, column: str, expected: int, bits: int | None = None) -> Bloom:
    """A filter of a column's values (null is none), 11 bits per expected value unless said otherwise.

    Its size is set by ``expected``, not by the data, and at most ``MOST_BITS`` (ValueError).
    """
    bits = bits or 11 * max(1, expected)
    if bits > MOST_BITS:
        raise ValueError(f"a filter of {bits} bits is larger than {MOST_BITS}")
    value = quoted(column)
    built = df.where(value.isNotNull()).agg(_jvm_column("BloomFilterAggregate", F.xxhash64(value), F.lit(expected).cast("long"), F.lit(bits).cast("long"), aggregate=True).alias("b")).first()[0]
    # Of no value there is no filter: one of a value that is not asked for stands in.
    return bloom_filter(df.sparkSession.range(1).select(F.lit("\0nothing").alias(column)), column, expected, bits) if built is None else Bloom(bytes(built))


def bloom_semi_join(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows whose key the other table has: a Bloom filter of its keys drops most of the rest before the exact join.

    Keys too many for a filter of ``MOST_BITS`` are joined without one.
    """
    keys = other.select(quoted(key)).where(quoted(key).isNotNull())
    expected = keys.agg(F.approx_count_distinct(quoted(key))).first()[0] * 11 // 10 + 1
    left = df.where(bloom_filter(keys, key, expected).may_contain(quoted(key))) if 11 * expected <= MOST_BITS else df
    return left.join(keys.distinct(), key, "left_semi")


def cluster_blooms(df: DataFrame, key: str, member: str, bits: int = 1 << 12, hashes: int = 7) -> DataFrame:
    """Per key a Bloom filter of its members as an array of ``bits / 64`` longs, and the first and last row.

    Bits are set by aggregation: (key, word) groups are combined on the map side.
    """
    places = F.array(*[F.pmod(F.xxhash64(F.lit(i), quoted(member)), F.lit(bits)) for i in range(hashes)])
    words = df.select(quoted(key).alias("k"), ROW, F.explode(places).alias("b")).groupBy("k", F.floor(F.col("b") / 64).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 AS int))")).alias("v"), F.min(ROW).alias("a"), F.max(ROW).alias("z"))
    filled = words.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("w", "v"))).alias("m"), F.min("a").alias("first_row"), F.max("z").alias("last_row"))
    return filled.select(F.col("k").alias(key), F.transform(F.sequence(F.lit(0), F.lit(bits // 64 - 1)), lambda i: F.coalesce(F.try_element_at("m", i.cast("long")), F.lit(0).cast("long"))).alias("bloom"), "first_row", "last_row")


def in_cluster_bloom(bloom: Column, member: Column, bits: int = 1 << 12, hashes: int = 7) -> Column:
    """May the member be in a filter of ``cluster_blooms``?"""
    out = F.lit(True)
    for i in range(hashes):
        place = F.pmod(F.xxhash64(F.lit(i), member), F.lit(bits))
        word = F.get(bloom, F.floor(place / 64).cast("int"))
        out = out & (word.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))) != 0)
    return out


def sorted_map(keys: Column, values: Column) -> Column:
    """A map with its keys in order, from an array of each; of equal keys the last wins."""
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(F.array_sort(last))
