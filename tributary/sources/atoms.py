"""Reading and writing records: JSON vectors to atom rows and back, quarantine of invalid atoms, logs, snapshots and checkpoints.

A vector file holds replicas as sparse records (field to value); absent fields are the lattice's identity, which is no rows. Values are read as text and projected, because
stamps are mixed arrays ``[pt, c, node]``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hlc import decode, encode, reject_reason
from ..functions.scalars import BOOL, INT, NULL, STR, tagged
from ..operators.merge import GROUP, STAMP
from ..schema import GSET, ORSET, REGISTER as REGISTER_KIND, SERIES, STATUS, Schema

KEYS = ["replica_id", "record_id", "field"]
OPLOG = "replica_id string, record_id string, field string, kind string, pt long, c long, node string, detail string, at long, log_seq long"


def read_vectors(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(name, kind, file, json) of every vector of a kind below path, by name. Descriptors without a kind are passed over."""
    whole = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("wholetext", True).text(path)
    parts = F.json_tuple("value", "name", "kind").alias("name", "kind")
    return whole.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("json"), parts).where(F.col("kind") == kind).select("name", "kind", "file", "json").orderBy("name")


def replicas(vectors: DataFrame, column: str = "json") -> DataFrame:
    """(name, replica_id, field, value as JSON text) of merge vectors."""
    records = F.from_json(F.get_json_object(column, "$.replicas"), "map<string, string>")
    one = vectors.select("name", F.explode(records).alias("replica_id", "record"))
    return one.select("name", "replica_id", F.explode(F.from_json("record", "map<string, string>")).alias("field", "value"))


def unknown_fields(rows: DataFrame, schema: Schema) -> DataFrame:
    """Fields that the schema does not declare: an error for who sends them."""
    return rows.where(~F.col("field").isin([f.name for f in schema.fields])).select("replica_id", "field").distinct()


def _stamp(array: str) -> list[Column]:
    parts = F.from_json(F.col(array), "array<string>")
    return [parts[0].cast("bigint").alias("pt"), parts[1].cast("bigint").alias("c"), parts[2].alias("node")]


def _fields(rows: DataFrame, schema: Schema, lattice: str) -> DataFrame:
    return rows.where(F.col("field").isin([f.name for f in schema.of(lattice)]))


def decode_series(rows: DataFrame, schema: Schema) -> DataFrame:
    each = _fields(rows, schema, SERIES).select(*KEYS, F.explode(F.from_json("value", "array<struct<value:long,taken_at:string,recorded_by:string,hlc:string,supersedes:string>>")).alias("e"))
    return each.select(*KEYS, "e.*").select(*KEYS, "value", "taken_at", "recorded_by", *_stamp("hlc"), "supersedes")


def tag_json(text: Column) -> Column:
    """The tagged struct of a JSON scalar's text (strings in quotes)."""
    bare = F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), "v string")["v"]
    return (
        F.when(text.isNull() | (text == "null"), tagged(F.lit(None).cast("string"), "str"))
        .when(text.isin("true", "false"), tagged(text == "true", "bool"))
        .when(text.rlike(r"^-?[0-9]+$"), tagged(F.when(text.rlike(r"^-?[0-9]+$"), text).cast("bigint"), "int"))
        .when(text.startswith('"'), tagged(bare, "str"))
    )


def decode_registers(rows: DataFrame, schema: Schema) -> DataFrame:
    """All observations of a register: the current one and its history. A value that is neither null, boolean, integer nor string has a null tag (see rejects)."""
    one = _fields(rows, schema, REGISTER_KIND).withColumn("v", F.parse_json("value"))
    current = F.struct(F.to_json(F.try_variant_get("v", "$.value", "variant")).alias("value"), F.to_json(F.try_variant_get("v", "$.hlc", "variant")).alias("hlc"), F.try_variant_get("v", "$.author", "string").alias("author"))
    old = F.transform(F.coalesce(F.try_variant_get("v", "$.history", "array<variant>"), F.array().cast("array<variant>")), lambda h: F.struct(F.to_json(F.try_variant_get(h, "$.value", "variant")).alias("value"), F.to_json(F.try_variant_get(h, "$.hlc", "variant")).alias("hlc"), F.try_variant_get(h, "$.author", "string").alias("author")))
    each = one.select(*KEYS, F.explode(F.concat(F.array(current), old)).alias("o")).select(*KEYS, "o.*").where("hlc IS NOT NULL")
    return each.withColumn("t", tag_json(F.coalesce("value", F.lit("null")))).select(*KEYS, "t.vtag", "t.vtext", "author", *_stamp("hlc"))


def decode_orset(rows: DataFrame, schema: Schema) -> tuple[DataFrame, DataFrame]:
    """(adds, removes)."""
    one = _fields(rows, schema, ORSET).select(*KEYS, F.from_json("value", "struct<adds:array<struct<element:string,tag:string>>,removed_tags:array<string>>").alias("s"))
    adds = one.select(*KEYS, F.explode("s.adds").alias("a")).select(*KEYS, "a.element", F.col("a.tag").alias("tag")).select(*KEYS, "element", *_stamp("tag"))
    removes = one.select(*KEYS, F.explode("s.removed_tags").alias("tag")).select(*KEYS, *_stamp("tag"))
    return adds, removes


def decode_gset(rows: DataFrame, schema: Schema) -> DataFrame:
    return _fields(rows, schema, GSET).select(*KEYS, F.explode(F.from_json("value", "array<string>")).alias("element"))


def decode_status(rows: DataFrame, schema: Schema) -> DataFrame:
    return _fields(rows, schema, STATUS).select(*KEYS, F.regexp_replace("value", '^"|"$', "").alias("value"))


def decode_records(rows: DataFrame, schema: Schema) -> dict[str, DataFrame]:
    """Atoms of (replica_id, record_id, field, value) by kind."""
    adds, removes = decode_orset(rows, schema)
    return {"entries": decode_series(rows, schema), "observations": decode_registers(rows, schema), "adds": adds, "removes": removes, "elements": decode_gset(rows, schema), "positions": decode_status(rows, schema)}


def _wire(prefix: str = "") -> Column:
    """[pt,c,"node"] as JSON text."""
    node = F.to_json(F.array(F.col(f"{prefix}node")))
    return F.concat(F.lit("["), F.col(f"{prefix}pt").cast("string"), F.lit(","), F.col(f"{prefix}c").cast("string"), F.lit(","), F.substring(node, 2, 1 << 30))


def _scalar(tag: Column, text: Column) -> Column:
    quoted = F.to_json(F.array(text))
    number = F.regexp_replace(F.regexp_replace(text, r"^\+", ""), r"^(-?)0+(?=\d)", "$1")
    return F.when(tag == NULL, "null").when(tag == BOOL, text).when(tag == INT, number).when(tag == STR, F.substring(quoted, F.lit(2), F.length(quoted) - 2))


def encode_series(merged: DataFrame) -> DataFrame:
    """(record_id, field, json): entries by stamp."""
    text = F.to_json(F.struct("recorded_by", "supersedes", "taken_at", "value"))
    with_stamp = F.concat(F.lit('{"hlc":'), _wire(), F.lit(","), F.substring(text, 2, 1 << 30))
    return _listed(merged, F.struct(*STAMP, with_stamp.alias("j")))


def encode_registers(merged: DataFrame) -> DataFrame:
    text = F.concat(F.lit('{"author":'), F.substring(F.to_json(F.array("author")), F.lit(2), F.length(F.to_json(F.array("author"))) - 2), F.lit(',"hlc":'), _wire(), F.lit(',"value":'), _scalar(F.col("vtag"), F.col("vtext")), F.lit("}"))
    return _listed(merged, F.struct(*STAMP, text.alias("j")))


def encode_orset(adds: DataFrame, removes: DataFrame) -> DataFrame:
    """Tags in the order of stamps; the order of the JSON text is not part of the contract."""
    element = F.to_json(F.array("element"))
    a = _listed(adds, F.struct(*STAMP, F.concat(F.lit('{"element":'), F.substring(element, F.lit(2), F.length(element) - 2), F.lit(',"tag":'), _wire(), F.lit("}")).alias("j")))
    r = _listed(removes, F.struct(*STAMP, _wire().alias("j"))).withColumnRenamed("json", "removed")
    return a.join(r, GROUP, "full_outer").select(*GROUP, F.concat(F.lit('{"adds":'), F.coalesce("json", F.lit("[]")), F.lit(',"removed_tags":'), F.coalesce("removed", F.lit("[]")), F.lit("}")).alias("json"))


def encode_gset(merged: DataFrame) -> DataFrame:
    return merged.groupBy(*GROUP).agg(F.to_json(F.sort_array(F.collect_set("element"))).alias("json"))


def encode_status(merged: DataFrame) -> DataFrame:
    return merged.select(*GROUP, F.concat(F.lit('"'), "value", F.lit('"')).alias("json"))


def _listed(rows: DataFrame, item: Column) -> DataFrame:
    ordered = rows.groupBy(*GROUP).agg(F.sort_array(F.collect_set(item)).alias("l"))
    return ordered.select(*GROUP, F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: x["j"]), ","), F.lit("]")).alias("json"))


def encode_records(fields: DataFrame) -> DataFrame:
    """(record_id, json) of (record_id, field, json): keys sorted."""
    by = fields.groupBy("record_id").agg(F.sort_array(F.collect_list(F.struct("field", "json"))).alias("l"))
    return by.select("record_id", F.concat(F.lit("{"), F.array_join(F.transform("l", lambda x: F.concat(F.lit('"'), x["field"], F.lit('":'), x["json"])), ","), F.lit("}")).alias("json"))


def quarantine(atoms: DataFrame, kind: str, schema: Schema | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid, rejects with reason). Nothing is dropped without a trace."""
    reason = reject_reason() if set(STAMP) <= set(atoms.columns) else F.lit(None).cast("string")
    rules = {
        "observations": [(F.col("vtag").isNull(), "value has no canonical form"), (F.coalesce(F.col("author"), F.lit("")) == "", "author is empty")],
        "entries": [(F.col("value").isNull(), "value is not an integer"), (F.coalesce(F.col("recorded_by"), F.lit("")) == "", "author is empty"), (F.col("taken_at").isNull(), "time of reading is missing")],
        "adds": [(F.col("element").isNull(), "element is missing")],
        "elements": [(F.col("element").isNull(), "element is missing")],
        "positions": [(F.col("value").isNull(), "status is missing")],
        "removes": [],
    }
    for test, why in rules[kind] if kind in rules else []:
        reason = F.coalesce(reason, F.when(test, why))
    if kind == "positions" and schema:
        declared = [(f.name, v) for f in schema.of(STATUS) for v in f.order.values]
        known = F.struct("field", "value").isin([F.struct(F.lit(a).alias("field"), F.lit(b).alias("value")) for a, b in declared]) if declared else F.lit(False)
        reason = F.coalesce(reason, F.when(~known, "status is not declared"))
    judged = atoms.withColumn("reason", reason)
    return judged.where("reason IS NULL").drop("reason"), judged.where("reason IS NOT NULL")


def strict(atoms: DataFrame, kind: str, schema: Schema | None = None) -> DataFrame:
    """atoms, or an error at run time for the first invalid one."""
    good, bad = quarantine(atoms, kind, schema)
    failed = bad.select(*[F.raise_error(F.col("reason")).cast(atoms.schema[c].dataType).alias(c) for c in atoms.columns])
    return good.unionByName(failed)


def snapshot(state: DataFrame, replica_id: str) -> DataFrame:
    return state.where(F.col("replica_id") == replica_id)


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """Seeds of a corpus text file: the first word of each line, without comments."""
    bare = F.trim(F.regexp_replace("value", "#.*", ""))
    return spark.read.text(path).select(F.split(bare, r"\s+")[0].alias("s")).where("s <> ''").select(F.col("s").cast("bigint").alias("seed"))


def write_failures(failures: DataFrame, path: str) -> None:
    failures.write.mode("overwrite").json(path)


def commit(state: DataFrame, path: str, version: int) -> None:
    """The durable copy of a state: a version of a table. A crash loses what was not committed."""
    state.write.mode("overwrite").parquet(f"{path}/version={version}")


def restart(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest durable copy, or None."""
    versions = spark.read.option("basePath", path).parquet(path)
    newest = versions.agg(F.max("version")).first()[0]
    return versions.where(F.col("version") == newest).drop("version") if newest is not None else None


def encoded_seen(seen: DataFrame) -> DataFrame:
    """The wire form of seen-sets: sorted encoded stamps, one array a replica."""
    return seen.groupBy("replica_id").agg(F.sort_array(F.collect_set(encode())).alias("seen"))


def decoded_seen(wire: DataFrame) -> DataFrame:
    return wire.select("replica_id", F.explode("seen").alias("t")).select("replica_id", decode(F.col("t")).alias("h")).select("replica_id", "h.*")




#: File formats of atom tables and the options that keep every value as it is.
FORMATS = {
    "parquet": {},
    "orc": {},
    "json": {"ignoreNullFields": "false"},
    "csv": {"header": "true", "nullValue": "\\N", "escape": '"'},
}


def write_atoms(rows: DataFrame, path: str, kind: str = "parquet") -> None:
    """A table of atoms in one of the formats."""
    rows.write.format(kind).options(**FORMATS[kind]).save(path)


def read_atoms(spark: SparkSession, path: str, schema, kind: str = "parquet") -> DataFrame:
    """A table of atoms of a schema; what text formats hold that does not fit it is an error."""
    strict_mode = {"mode": "FAILFAST"} if kind in ("csv", "json") else {}
    return spark.read.format(kind).schema(schema).options(**FORMATS[kind], **strict_mode).load(path)
