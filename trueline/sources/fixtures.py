"""Stand-in series built from the driver's ``events`` table.

These only map ``events`` rows into the schemas the calibration jobs
expect (reference: timestamp + target + one other numeric column; sensor:
timestamp + numeric features).  They do none of the jobs' work: every
operator downstream runs on them as it would on any input of that schema.
The SQL text of each builder is also what the DuckDB oracle uses.

In the dirty sensor stand-in the ``event_id`` modulo conditions inject
defects (unparseable timestamps, NULLs, spikes) and a UNION adds duplicate
timestamps; every ``events`` row is kept, none is filtered out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixture SQL over `events`, shared by Spark and the oracle.
REF_CLEAN_SQL = ("SELECT ts AS timestamp, value AS pm25, CAST(user_id AS DOUBLE) AS temperature FROM events")
SEN_CLEAN_SQL = ("SELECT ts + INTERVAL '2' HOUR AS timestamp, "
                 "0.8 * value + 0.05 * user_id + 3.0 AS pm25_raw, "
                 "CAST(user_id AS DOUBLE) AS humidity, "
                 "CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS voc, "
                 "5.0E0 AS flat FROM events")
SEN_DIRTY_SQL = ("SELECT CASE WHEN event_id % 97 = 0 THEN 'bad' ELSE CAST(ts AS STRING) END AS timestamp, "
                 "CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 101 = 0 THEN value * 50 ELSE value END AS pm25_raw, "
                 "CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(user_id AS DOUBLE) END AS humidity "
                 "FROM events "
                 "UNION ALL "
                 "SELECT CAST(ts AS STRING), value + 1000, CAST(user_id AS DOUBLE) FROM events WHERE event_id % 50 = 0")
# growth factors near 1 (products stay well inside double precision)
GROWTH_SQL = "SELECT ts AS timestamp, 1.0 + value / 1000.0 AS factor FROM events"
# keyed variants: one series per event_type
REF_KEYED_SQL = ("SELECT event_type, ts AS timestamp, value AS pm25, CAST(user_id AS DOUBLE) AS temperature FROM events")
SEN_KEYED_SQL = ("SELECT event_type, ts + INTERVAL '2' HOUR AS timestamp, "
                 "0.8 * value + 0.05 * user_id + 3.0 AS pm25_raw, "
                 "CAST(user_id AS DOUBLE) AS humidity FROM events")


# NaN and NULL readings
SEN_NAN_SQL = ("SELECT ts AS timestamp, CASE WHEN event_id % 11 = 0 THEN CAST('NaN' AS DOUBLE) ELSE value END AS pm25_raw, "
               "CASE WHEN event_id % 13 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(user_id AS DOUBLE) END AS humidity FROM events")
# readings as text with missing-value tokens
REF_TOKENS_SQL = ("SELECT CAST(ts AS STRING) AS timestamp, CASE WHEN event_id % 9 = 0 THEN 'NA' WHEN event_id % 17 = 0 "
                  "THEN 'null' ELSE CAST(value AS STRING) END AS pm25, user_id FROM events")
# a third of the users without a series name
NULL_KEY_SQL = ("SELECT CASE WHEN user_id % 3 = 0 THEN NULL ELSE event_type END AS series, ts AS timestamp, value AS pm25 "
                "FROM events")
# timestamps as text, some with an offset
OFFSET_SQL = ("SELECT event_id, CASE event_id % 4 WHEN 0 THEN concat(CAST(ts AS STRING), '+05:30') "
              "WHEN 1 THEN concat(CAST(ts AS STRING), '-0800') WHEN 2 THEN concat(CAST(ts AS STRING), 'Z') "
              "ELSE CAST(ts AS STRING) END AS timestamp FROM events")
# timestamps as text of a named pattern
FORMAT_SQL = "SELECT event_id, date_format(ts, 'dd/MM/yyyy HH:mm:ss') AS timestamp FROM events"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _from_events(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return spark.sql(sql, events=events) if "{events}" in sql else \
        spark.sql(sql.replace("FROM events", "FROM {events}"), events=events)


def ref_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from_events(spark, sf_dir, REF_CLEAN_SQL)


def sen_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from_events(spark, sf_dir, SEN_CLEAN_SQL)


def sen_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from_events(spark, sf_dir, SEN_DIRTY_SQL)


def sen_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from_events(spark, sf_dir, SEN_NAN_SQL)


def ref_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from_events(spark, sf_dir, REF_TOKENS_SQL)


def null_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from_events(spark, sf_dir, NULL_KEY_SQL)


def offset_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from_events(spark, sf_dir, OFFSET_SQL)


def format_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from_events(spark, sf_dir, FORMAT_SQL)


def growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from_events(spark, sf_dir, GROWTH_SQL)


def ref_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from_events(spark, sf_dir, REF_KEYED_SQL)


def sen_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from_events(spark, sf_dir, SEN_KEYED_SQL)
