"""Statistics of units, as DataFrames over the log, and their driver-side form."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillvec.model import MUTABLE_UNIT, Scalar
from quillvec.operators import mvcc
from quillvec.operators.predicate import as_double, as_string, as_whole, kind_of, leaf_kind


def summary_key(value: Scalar) -> str:
    """The name of a scalar in histograms."""
    kind = kind_of(value)
    if kind == "null":
        return "null"
    if kind == "bool":
        return f"bool:{str(value).lower()}"
    if kind == "string":
        return f"string:{value}"
    return f"number:{value}" if kind == "int" else f"number:{float_text(value)}"


def float_text(x: float) -> str:
    """A float in shortest decimal form; exponents without plus sign or padding."""
    text = repr(float(x))
    if "e" not in text:
        return text
    mantissa, exponent = text.split("e")
    return f"{mantissa.removesuffix('.0')}e{int(exponent)}"


@dataclass
class FieldStats:
    """A field of a unit. `counts` may hold only the values a query asks for; the totals are always whole."""

    present: int = 0
    nulls: int = 0
    distinct: int = 0
    least: Scalar | None = None
    most: Scalar | None = None
    counts: dict[str, int] = field(default_factory=dict)
    strings: int = 0
    numbers: int = 0
    scalars: int = 0

    def add(self, value: object) -> None:
        """Count one value; used where statistics are built in memory."""
        self.present += 1
        kind = kind_of(value)
        if kind is None:
            return
        self.scalars += 1
        self.counts[summary_key(value)] = self.counts.get(summary_key(value), 0) + 1
        self.distinct = len(self.counts)
        if kind == "null":
            self.nulls += 1
            return
        self.strings += kind == "string"
        self.numbers += kind in ("int", "float")
        if self.least is None or rank_of(value) < rank_of(self.least):
            self.least = value
        if self.most is None or rank_of(value) > rank_of(self.most):
            self.most = value


def rank_of(value: Scalar) -> tuple:
    """Sorts scalars of all types: booleans, then numbers, then strings by their bytes."""
    kind = kind_of(value)
    return (0, value) if kind == "bool" else (1, value) if kind in ("int", "float") else (2, str(value).encode("utf-8", "surrogatepass"))


@dataclass
class UnitStats:
    unit_id: str
    tier: str
    index_kind: str
    min_seq_no: int
    max_seq_no: int
    put_count: int
    delete_count: int
    approx_bytes: int = 0
    fields: dict[str, FieldStats] = field(default_factory=dict)


def approx_bytes() -> Column:
    """Bytes accounted for an operation: id, vector, metadata and a fixed part."""
    put = F.octet_length("id") + 4 * F.size("vector") + F.octet_length("metadata") + 32
    return F.when(F.col("op") == "put", put).otherwise(F.octet_length("id") + 16).cast("long")


def unit_counts(log: DataFrame) -> DataFrame:
    """Per unit: puts, deletes, first and last sequence number, bytes."""
    put = F.col("op") == "put"
    return log.groupBy("unit_id").agg(
        F.count_if(put).alias("put_count"), F.count_if(~put).alias("delete_count"), F.min("seq_no").alias("min_seq_no"), F.max("seq_no").alias("max_seq_no"), F.sum(approx_bytes()).alias("approx_bytes")
    )


def field_values(log: DataFrame, fields: Iterable[str] | None = None) -> DataFrame:
    """One row for every top-level metadata field of every put: `(unit_id, field, kind, whole, number, string, key)`."""
    puts = log.where(F.col("op") == "put").select("unit_id", F.try_parse_json("metadata").alias("_m")).where(F.schema_of_variant("_m").startswith("OBJECT"))
    each = puts.lateralJoin(log.sparkSession.tvf.variant_explode(F.col("_m").outer()))
    rows = each.select("unit_id", F.col("key").alias("field"), F.col("value").alias("v"))
    if fields is not None:
        rows = rows.where(F.col("field").isin(*fields) if fields else F.lit(False))
    v = F.col("v")
    rows = rows.withColumn("kind", leaf_kind(v))
    kind = F.col("kind")
    key = (
        F.when(kind == "null", "null").when(kind == "bool", F.concat(F.lit("bool:"), as_string(v))).when(kind == "string", F.concat(F.lit("string:"), as_string(v)))
        .when(kind == "int", F.concat(F.lit("number:"), as_whole(v).cast("string"))).when(kind == "float", F.concat(F.lit("number:"), float_column(as_double(v))))
    )
    number = F.when(kind.isin("int", "float"), as_double(v))
    return rows.select(
        "unit_id", "field", "kind", F.when(kind == "int", as_whole(v)).alias("whole"), number.alias("number"), F.when(kind.isin("string", "bool"), as_string(v)).alias("string"), key.alias("key")
    )


def float_column(x: Column) -> Column:
    """`float_text` as a Column; Java writes exponents differently and from other sizes on."""
    text = x.cast("string")
    plain = (F.abs(x) < 1e16) & (F.abs(x) >= 1e-5)
    whole = F.concat(x.cast("decimal(38,0)").cast("string"), F.lit(".0"))
    small = F.regexp_replace(x.cast("decimal(38,25)").cast("string"), "0+$", "")
    spelled = F.when(x == F.floor(x), whole).otherwise(small)
    return F.when(~text.contains("E"), text).when(plain, spelled).otherwise(F.regexp_replace(text, r"(\.0)?E", "e"))


def field_stats(log: DataFrame, fields: Iterable[str] | None = None) -> DataFrame:
    """Per unit and field (all, or some): counts, distinct scalars, and the least and greatest value over all types."""
    rows = field_values(log, fields)
    kind = F.col("kind")
    rank = F.when(kind == "bool", 0).when(kind.isin("int", "float"), 1).when(kind == "string", 2)
    typed = F.when(rank.isNotNull(), F.struct(rank.alias("rank"), F.col("number"), F.col("whole"), F.col("string"), F.col("kind"), F.col("key")))
    return rows.groupBy("unit_id", "field").agg(
        F.count("*").alias("present_count"), F.count_if(kind == "null").alias("null_count"), F.countDistinct("key").alias("distinct_count"), F.count("key").alias("scalar_count"),
        F.count_if(kind == "string").alias("string_count"), F.count_if(kind.isin("int", "float")).alias("number_count"), F.min(typed).alias("least"), F.max(typed).alias("most"),
    )


def field_histogram(log: DataFrame, fields: Iterable[str] | None = None) -> DataFrame:
    """Per unit, field and scalar: how often it occurs."""
    return field_values(log, fields).where(F.col("key").isNotNull()).groupBy("unit_id", "field", F.col("key").alias("value_key")).agg(F.count("*").alias("n"))


def scalar_of(row) -> Scalar | None:
    """The value of a `least` or `most` struct."""
    if row is None:
        return None
    if row["kind"] == "bool":
        return row["string"] == "true"
    if row["kind"] == "string":
        return row["string"]
    return int(row["whole"]) if row["kind"] == "int" else row["number"]


def units_from(counts: DataFrame, fields: DataFrame, histogram: DataFrame, names: set[str], keys: set[str], index_kinds: dict[str, str]) -> list[UnitStats]:
    """Statistics for planning: a row for each unit, of the fields and values a predicate names."""
    units = {
        r["unit_id"]: UnitStats(
            r["unit_id"], "mutable" if r["unit_id"] == MUTABLE_UNIT else "immutable", "raw" if r["unit_id"] == MUTABLE_UNIT else index_kinds.get(r["unit_id"], "raw"),
            r["min_seq_no"], r["max_seq_no"], r["put_count"], r["delete_count"], r["approx_bytes"],
        )
        for r in counts.collect()
    }
    if names:
        for r in fields.where(F.col("field").isin(*names)).collect():
            units[r["unit_id"]].fields[r["field"]] = FieldStats(r["present_count"], r["null_count"], r["distinct_count"], scalar_of(r["least"]), scalar_of(r["most"]), {}, r["string_count"], r["number_count"], r["scalar_count"])
        if keys:
            for r in histogram.where(F.col("field").isin(*names) & F.col("value_key").isin(*keys)).collect():
                units[r["unit_id"]].fields[r["field"]].counts[r["value_key"]] = r["n"]
    return list(units.values())


def planning_stats(log: DataFrame, names: set[str], keys: set[str], index_kinds: dict[str, str]) -> list[UnitStats]:
    """Statistics of a log's units for planning; only the fields that are named are taken out of the metadata."""
    return units_from(unit_counts(log), field_stats(log, names), field_histogram(log, names), names, keys, index_kinds)


def collection_stats(log: DataFrame, visible_seq_no: int | None = None) -> DataFrame:
    """One row: live and deleted ids, operations in the mutable unit, immutable units."""
    log = mvcc.at(log, visible_seq_no)
    newest = mvcc.latest(log).select("op", F.lit(None).cast("string").alias("unit_id"), F.lit(0).cast("long").alias("n"))
    units = log.groupBy("unit_id").count().select(F.lit(None).cast("string").alias("op"), "unit_id", F.col("count").alias("n"))
    mutable = F.col("unit_id") == MUTABLE_UNIT
    return newest.unionByName(units).agg(
        F.count_if(F.col("op") == "put").alias("live_count"), F.count_if(F.col("op") == "delete").alias("deleted_count"),
        F.coalesce(F.sum(F.when(mutable, F.col("n"))), F.lit(0)).alias("mutable_ops"), F.count_if(~mutable).alias("segment_count"),
    )
