"""Scans, sinks, listings, checksums and casts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.functions import entity_id, epoch_seconds, label_of, lenient_double
from sensorloom.plans.fixtures import (
    EEG_SQL,
    EVENT_STREAMS,
    SAMPLES_SQL,
    event_samples,
    table,
    wide_eeg,
)
from sensorloom.plans.queries.common import r, rounded
from sensorloom.schema import EEG_CHANNELS
from sensorloom.sources.checksums import (
    available_in,
    file_checksums,
    read_manifest,
    unavailable_in,
    verify_checksums,
)
from sensorloom.sources.numeric import STREAM_FILES, WORN_COLUMN, device_worn, scan_numeric_csv
from sensorloom.sources.scratch import new_path
from sensorloom.sources.sessions import (
    CONDITIONS,
    expected_files,
    file_sizes,
    list_files,
    missing_files,
    session_grid,
    session_index,
    stream_preview,
)
from sensorloom.sources.tables import cached_table, write_csv, write_json


def _spoiled_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events as text: sign-ups have no usable time, errors and views no usable value."""
    kind = F.col("event_type")
    return table(spark, folder, "events").select(
        "event_id",
        "event_type",
        F.when(kind == "signup", "late").otherwise(epoch_seconds("ts").cast("string")).alias("time"),
        F.when(kind == "error", "n/a")
        .when(kind == "view", "")
        .otherwise(F.col("value").cast("string"))
        .alias("value"),
        "props",
    )


def numeric_csv_scan(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "events-csv")
    write_csv(_spoiled_events(spark, folder), path)
    scanned = scan_numeric_csv(spark, path, ["time", "value"], keep=["event_id"])
    return rounded(scanned.withColumn("event_id", F.col("event_id").cast("long")))


NUMERIC_CSV_SCAN = f"""
SELECT event_id, {r('epoch_us(ts) / 1e6')} AS "time",
       {r("CASE WHEN event_type NOT IN ('error', 'view') THEN value END")} AS value
FROM events WHERE event_type <> 'signup'"""


def reordered_csv_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The same scan where the files of every other day have their columns in another order, and one more."""
    path = new_path(spark, "reordered-csv")
    day = F.datediff("ts", F.lit("1970-01-01")) % 2
    spoiled = _spoiled_events(spark, folder).join(
        table(spark, folder, "events").select("event_id", day.alias("odd")), "event_id"
    )
    for odd, columns in enumerate((["event_id", "event_type", "time", "value"], ["value", "props", "time", "event_type", "event_id"])):
        write_csv(spoiled.where(F.col("odd") == odd).select(*columns), f"{path}/{odd}")
    scanned = scan_numeric_csv(spark, f"{path}/*", ["time", "value"], keep=["event_id"])
    return rounded(scanned.withColumn("event_id", F.col("event_id").cast("long")))


def drop_null_time(spark: SparkSession, folder: str) -> DataFrame:
    """Sign-ups come without a time and errors without a value; only the former are dropped."""
    timed = table(spark, folder, "events").select(
        "event_id",
        F.when(F.col("event_type") != "signup", epoch_seconds("ts")).alias("time"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("value"),
    )
    return rounded(timed.dropna(subset=["time"]))


DROP_NULL_TIME = f"""
SELECT event_id, {r('epoch_us(ts) / 1e6')} AS "time",
       {r("CASE WHEN event_type <> 'error' THEN value END")} AS value
FROM events WHERE event_type <> 'signup'"""


def lenient_cast(spark: SparkSession, folder: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    spellings = ["abc", "", "1e3", " 7 ", "1.5d", "NaN", "-2.", ".5"]
    text = F.col("value").cast("string")
    for at, spelling in enumerate(spellings):
        text = F.when(k % 12 == at, spelling).otherwise(text)
    spelled = table(spark, folder, "events").select("event_id", text.alias("spelled"))
    return rounded(spelled.select("event_id", lenient_double("spelled").alias("number")))


LENIENT_CAST = f"""
SELECT event_id, {r('''CASE CAST(json_extract_string(props, '$.k') AS INTEGER) % 12
  WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN 1000.0 WHEN 3 THEN 7.0 WHEN 4 THEN NULL
  WHEN 5 THEN NULL WHEN 6 THEN -2.0 WHEN 7 THEN 0.5 ELSE value END''')} AS number
FROM events"""


def device_worn_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The flag is unknown for sign-ups, zero for errors and one otherwise."""
    kind = F.col("event_type")
    worn = F.when(kind == "signup", F.lit(None)).when(kind == "error", 0.0).otherwise(1.0)
    flagged = table(spark, folder, "events").select("event_id", worn.alias(WORN_COLUMN))
    return device_worn(flagged).select("event_id")


DEVICE_WORN_ROWS = """
SELECT event_id FROM events WHERE event_type NOT IN ('signup', 'error')"""


def session_streams(spark: SparkSession, folder: str) -> DataFrame:
    """Each stream written as headed CSV, scanned by name, and united in long form."""
    samples = event_samples(spark, folder)
    eeg_path = new_path(spark, "eeg-csv")
    worn = F.when(F.col("Delta_TP9").isNotNull(), 1.0)
    write_csv(wide_eeg(samples).withColumn(WORN_COLUMN, worn), eeg_path)
    keys = ["patient_id", "condition"]
    eeg = device_worn(scan_numeric_csv(spark, eeg_path, ["time", WORN_COLUMN, *EEG_CHANNELS], keys))
    parts = [eeg.select(*keys, F.lit("eeg").alias("stream"), "time", F.col("Gamma_TP10").alias("value"))]
    for stream in (s for s in EVENT_STREAMS if s != "eeg"):
        path = new_path(spark, f"{stream}-csv")
        write_csv(samples.where(F.col("stream") == stream).drop("stream"), path)
        scanned = scan_numeric_csv(spark, path, ["time", "value"], keys)
        parts.append(scanned.select(*keys, F.lit(stream).alias("stream"), "time", "value"))
    return rounded(reduce(DataFrame.unionByName, parts))


SESSION_STREAMS = f"""
WITH {SAMPLES_SQL}, {EEG_SQL}
SELECT patient_id, condition, 'eeg' AS stream, {r('"time"')} AS "time", {r('Gamma_TP10')} AS value
FROM eeg WHERE Delta_TP9 IS NOT NULL
UNION ALL
SELECT patient_id, condition, stream, {r('"time"')}, {r('value')} FROM samples WHERE stream <> 'eeg'"""


def _participants(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(F.col("c_custkey").alias("participant_number"))


def session_index_rows(spark: SparkSession, folder: str) -> DataFrame:
    return session_index(_participants(spark, folder), "/raw")


_INDEX_SQL = """grid AS (
  SELECT c_custkey AS participant_number, condition, target_cognitive_load
  FROM customer, (VALUES ('baseline', 0), ('cognitive_load', 1)) AS c(condition, target_cognitive_load)),
files(stream, name) AS (VALUES ('eeg', 'muse_eeg.csv'), ('bvp', 'empatica_bvp.csv'),
  ('eda', 'empatica_eda.csv'), ('temperature', 'empatica_temp.csv'))"""

SESSION_INDEX_ROWS = f"""
WITH {_INDEX_SQL}
SELECT printf('p_%02d', participant_number) AS patient_id, participant_number, condition,
       target_cognitive_load,
       concat('/raw/', participant_number, '/', condition, '/muse_eeg.csv') AS eeg_path,
       concat('/raw/', participant_number, '/', condition, '/empatica_bvp.csv') AS bvp_path,
       concat('/raw/', participant_number, '/', condition, '/empatica_eda.csv') AS eda_path,
       concat('/raw/', participant_number, '/', condition, '/empatica_temp.csv') AS temperature_path
FROM grid"""


def session_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return session_grid(_participants(spark, folder), CONDITIONS)


SESSION_PAIRS = f"WITH {_INDEX_SQL} SELECT * FROM grid"


def entity_ids(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        "c_custkey", entity_id("c_custkey", "p_", 2).alias("patient_id")
    )


ENTITY_IDS = "SELECT c_custkey, printf('p_%02d', c_custkey) AS patient_id FROM customer"


def label_mapping(spark: SparkSession, folder: str) -> DataFrame:
    labels = {"R": 1, "A": 0}
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", label_of("l_returnflag", labels).alias("label")
    )


LABEL_MAPPING = """
SELECT l_orderkey, l_linenumber, l_partkey,
       CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 0 END AS label FROM lineitem"""


def _present_files(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of the streams for which events exist."""
    samples = event_samples(spark, folder).select("patient_id", "condition", "stream").distinct()
    number = F.substring("patient_id", 3, 20).cast("int").cast("string")
    name = F.lit(None).cast("string")
    for stream, file_name in STREAM_FILES.items():
        name = F.when(F.col("stream") == stream, file_name).otherwise(name)
    # Sign-ups have no file: a session that has only these and three streams lacks one.
    samples = samples.withColumn("name", name).where(F.col("name").isNotNull())
    return samples.select(F.concat_ws("/", F.lit("/raw"), number, "condition", "name").alias("path"))


def missing_session_files(spark: SparkSession, folder: str) -> DataFrame:
    expected = expected_files(session_index(_participants(spark, folder), "/raw"))
    return missing_files(expected, _present_files(spark, folder)).select("patient_id", "stream", "path")


MISSING_SESSION_FILES = f"""
WITH {SAMPLES_SQL}, {_INDEX_SQL},
present AS (
  SELECT DISTINCT concat('/raw/', CAST(substr(patient_id, 3) AS INTEGER), '/', condition, '/', name) AS path
  FROM samples JOIN files USING (stream)),
expected AS (
  SELECT printf('p_%02d', participant_number) AS patient_id, stream,
         concat('/raw/', participant_number, '/', condition, '/', name) AS path
  FROM grid, files)
SELECT patient_id, stream, path FROM expected WHERE path NOT IN (SELECT path FROM present)"""


def stream_heads(spark: SparkSession, folder: str) -> DataFrame:
    samples = event_samples(spark, folder).select("stream", "time", "event_id", "patient_id", "value")
    return rounded(stream_preview(samples, list(EVENT_STREAMS), rows=5))


STREAM_HEADS = f"""
WITH {SAMPLES_SQL}
SELECT stream, {r('"time"')} AS "time", event_id, patient_id, {r('value')} AS value
FROM (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY "time", event_id) AS n FROM samples)
WHERE n <= 5"""


def stream_file_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes on disk per stream, of the samples written as lines of text by stream."""
    path = new_path(spark, "by-stream")
    event_samples(spark, folder).select("event_id", "patient_id", "stream").write.partitionBy("stream").csv(path)
    listing = list_files(spark, path)
    expected = listing.select("path", F.regexp_extract("path", "stream=([^/]+)/", 1).alias("stream"))
    return file_sizes(expected, listing).groupBy("stream").agg(F.sum("bytes").alias("bytes"))


STREAM_FILE_SIZES = f"""
WITH {SAMPLES_SQL}
SELECT stream, CAST(sum(strlen(event_id || ',' || patient_id) + 1) AS BIGINT) AS bytes FROM samples GROUP BY stream"""


def _document_paths(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        F.format_string("texts/%d.txt", "doc_id").alias("path"),
        F.sha2("text", 256).alias("checksum"),
        "lang",
    )


def checksum_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Manifest lines of all documents written as text and parsed back."""
    path = new_path(spark, "manifest")
    lines = _document_paths(spark, folder).select(F.concat("checksum", F.lit("  \t"), "path", F.lit(" ")))
    lines.write.text(path)
    return read_manifest(spark, path)


CHECKSUM_MANIFEST = """
SELECT sha256(text) AS checksum, concat('texts/', doc_id, '.txt') AS path FROM documents"""


def checksum_verification(spark: SparkSession, folder: str) -> DataFrame:
    """Each text against a manifest that is right for English, wrong for French, silent otherwise."""
    documents = _document_paths(spark, folder)
    manifest = documents.where(F.col("lang").isin("en", "fr")).select(
        "path",
        F.when(F.col("lang") == "en", F.col("checksum"))
        .otherwise(F.sha2("path", 256))
        .alias("checksum"),
    )
    return verify_checksums(documents.select("path", "checksum"), manifest)


CHECKSUM_VERIFICATION = """
SELECT concat('texts/', doc_id, '.txt') AS path, sha256(text) AS checksum,
       CASE lang WHEN 'en' THEN sha256(text) WHEN 'fr' THEN sha256(concat('texts/', doc_id, '.txt')) END
         AS expected,
       CASE lang WHEN 'en' THEN 'verified' WHEN 'fr' THEN 'mismatch' ELSE 'unlisted' END AS status
FROM documents"""


# Documents of one written file; a file is read in blocks smaller than most of them.
FILE_DOCUMENTS, FILE_BLOCK = 50, 1 << 14


def file_checksum_verification(spark: SparkSession, folder: str) -> DataFrame:
    """Documents written as files and hashed there, against a manifest that lists some and is wrong on others."""
    path = new_path(spark, "document-files")
    number = F.expr(f"doc_id div {FILE_DOCUMENTS}")
    documents = table(spark, folder, "documents").select(number.alias("file"), "doc_id", "text")
    (
        documents.repartition("file")
        .sortWithinPartitions("file", "doc_id")
        .select(F.coalesce("text", F.lit("")).alias("text"), "file")
        .write.partitionBy("file")
        .text(path)
    )
    parts = F.sort_array(F.collect_list(F.struct("doc_id", F.coalesce("text", F.lit("")).alias("text"))))
    content = F.concat(F.array_join(F.transform(parts, lambda x: x["text"]), "\n"), F.lit("\n"))
    listed = documents.groupBy("file").agg(F.sha2(content, 256).alias("right")).where(F.col("file") % 5 != 0)
    wrong = F.sha2(F.col("file").cast("string"), 256)
    manifest = listed.select(
        F.format_string("file=%d", "file").alias("path"), F.when(F.col("file") % 7 == 0, wrong).otherwise(F.col("right")).alias("checksum")
    )
    hashed = file_checksums(spark, path, path, "*.txt", FILE_BLOCK)
    return verify_checksums(hashed.withColumn("path", F.regexp_extract("path", "file=[^/]+", 0)), manifest)


FILE_CHECKSUM_VERIFICATION = f"""
WITH files AS (
  SELECT doc_id // {FILE_DOCUMENTS} AS file, sha256(string_agg(coalesce(text, '') || chr(10), '' ORDER BY doc_id)) AS checksum
  FROM documents GROUP BY ALL),
manifest AS (
  SELECT file, CASE WHEN file % 7 = 0 THEN sha256(CAST(file AS VARCHAR)) ELSE checksum END AS expected
  FROM files WHERE file % 5 <> 0)
SELECT 'file=' || file AS path, checksum, expected,
       CASE WHEN expected IS NULL THEN 'unlisted' WHEN expected = checksum THEN 'verified' ELSE 'mismatch' END AS status
FROM files LEFT JOIN manifest USING (file)"""


def requested_against_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Requested documents split by whether the label table publishes them."""
    requested = _document_paths(spark, folder).select("path")
    manifest = table(spark, folder, "labels").select(F.format_string("texts/%d.txt", "doc_id").alias("path"))
    return (
        available_in(requested, manifest)
        .withColumn("state", F.lit("available"))
        .unionByName(unavailable_in(requested, manifest).withColumn("state", F.lit("unavailable")))
    )


REQUESTED_AGAINST_MANIFEST = """
SELECT concat('texts/', d.doc_id, '.txt') AS path,
       CASE WHEN d.doc_id IN (SELECT doc_id FROM labels) THEN 'available' ELSE 'unavailable' END AS state
FROM documents d"""


def _user_levels(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "events")
        .groupBy("user_id", "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"))
    )


_USER_LEVELS = f"""
SELECT user_id, event_type, count(*) AS n, {r('avg(value)')} AS mean_value FROM events GROUP BY ALL"""


def feature_table_cache(spark: SparkSession, folder: str) -> DataFrame:
    """Built once, then read back under the same parameters."""
    root = new_path(spark, "cache")
    settings = {"by": "user", "source": folder}
    cached_table(spark, root, "levels", settings, lambda: _user_levels(spark, folder))

    def never() -> DataFrame:
        raise AssertionError("The cached table was not found.")

    return rounded(cached_table(spark, root, "levels", settings, never))


def input_keyed_cache(spark: SparkSession, folder: str) -> DataFrame:
    """A table is built again when its input has changed, and only then."""
    root, source = new_path(spark, "cache"), new_path(spark, "cache-input")
    events = table(spark, folder, "events").select("user_id", "event_type", "value")
    built = []

    def levels() -> DataFrame:
        built.append(1)
        return (
            spark.read.parquet(source)
            .groupBy("user_id", "event_type")
            .agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"))
        )

    events.where(F.col("event_type") == "click").write.parquet(source)
    for _ in range(2):
        cached_table(spark, root, "levels", {"by": "user"}, levels, inputs=[source])
    events.where(F.col("event_type") != "click").write.mode("append").parquet(source)
    for _ in range(2):
        found = cached_table(spark, root, "levels", {"by": "user"}, levels, inputs=[source])
    if len(built) != 2:
        raise AssertionError(f"The table was built {len(built)} times.")
    return rounded(found)


def csv_sink(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "csv-sink")
    levels = _user_levels(spark, folder)
    write_csv(levels, path)
    return rounded(spark.read.option("header", True).schema(levels.schema).csv(path))


def json_sink(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "json-sink")
    nested = _user_levels(spark, folder).select(
        "user_id", F.struct("event_type", "n", "mean_value").alias("level")
    )
    write_json(nested, path)
    return rounded(spark.read.schema(nested.schema).json(path).select("user_id", "level.*"))


QUERIES = {
    "numeric_csv_scan": (numeric_csv_scan, NUMERIC_CSV_SCAN),
    "reordered_csv_scan": (reordered_csv_scan, NUMERIC_CSV_SCAN),
    "drop_null_time": (drop_null_time, DROP_NULL_TIME),
    "lenient_cast": (lenient_cast, LENIENT_CAST),
    "device_worn_rows": (device_worn_rows, DEVICE_WORN_ROWS),
    "session_streams": (session_streams, SESSION_STREAMS),
    "session_index": (session_index_rows, SESSION_INDEX_ROWS),
    "session_pairs": (session_pairs, SESSION_PAIRS),
    "entity_ids": (entity_ids, ENTITY_IDS),
    "label_mapping": (label_mapping, LABEL_MAPPING),
    "missing_session_files": (missing_session_files, MISSING_SESSION_FILES),
    "stream_heads": (stream_heads, STREAM_HEADS),
    "stream_file_sizes": (stream_file_sizes, STREAM_FILE_SIZES),
    "checksum_manifest": (checksum_manifest, CHECKSUM_MANIFEST),
    "checksum_verification": (checksum_verification, CHECKSUM_VERIFICATION),
    "file_checksum_verification": (file_checksum_verification, FILE_CHECKSUM_VERIFICATION),
    "requested_against_manifest": (requested_against_manifest, REQUESTED_AGAINST_MANIFEST),
    "feature_table_cache": (feature_table_cache, _USER_LEVELS),
    "input_keyed_cache": (input_keyed_cache, _USER_LEVELS),
    "csv_sink": (csv_sink, _USER_LEVELS),
    "json_sink": (json_sink, _USER_LEVELS),
}
