"""Raw event rows as partitioned JSON lines, and other record forms of cost and scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STREAMS = ("cost", "pii", "id_gate", "usage", "ratelimit")


def write_history(df: DataFrame, base: str, stream: str, ts_col: str = "ts", max_records: int = 1000, streams: tuple[str, ...] | None = None) -> None:
    """Appends rows to ``base/stream/dt=…/hour=…`` as gzip JSON lines of at most ``max_records`` rows; streams not listed are left out.

    Rows are dealt to their hour by a hash of the row too, so an hour of very many rows is written by many tasks.
    Folders on a file system of the machine are written by the format ``history``, for Spark's JSON writer took
    some 14 ms of a task for each small file there; other stores by that writer.
    """
    if stream not in STREAMS:
        raise ValueError(f"unknown stream {stream}")
    if streams is not None and stream not in streams:
        return
    ts = F.col(ts_col)
    rows = df.withColumns({"dt": F.date_format(ts, "yyyy-MM-dd"), "hour": F.date_format(ts, "HH")})
    rows = rows.repartition("dt", "hour", F.pmod(F.xxhash64(*df.columns), F.lit(16)))
    if "://" in base and not base.startswith("file:"):
        rows.write.mode("append").partitionBy("dt", "hour").option("compression", "gzip").option("maxRecordsPerFile", max_records).json(f"{base}/{stream}")
        return
    from tollhouse.sources.history_source import register

    register(df.sparkSession)
    fields = [F.col(c) for c in df.columns if c not in ("dt", "hour")]
    lines = rows.select(F.to_json(F.struct(*fields)).alias("line"), "dt", "hour").sortWithinPartitions("dt", "hour")
    lines.write.format("history").mode("append").option("maxrecords", max_records).save(f"{base}/{stream}")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a file or folder, in any Hadoop store."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where)


def read_history(spark: SparkSession, base: str, stream: str, schema: str, days: list[str] | None = None) -> DataFrame:
    """Rows of a stream with dt and hour; of ``days`` alone the folders are listed."""
    root = f"{base}/{stream}"
    reader = spark.read.schema(schema + ", dt string, hour string").option("basePath", root)
    if days is None:
        return reader.json(root)
    folders = [f"{root}/dt={d}" for d in dict.fromkeys(days) if exists(spark, f"{root}/dt={d}")]
    return reader.json(folders or root).filter(F.col("dt").isin(days))


def write_cost_jsonl(cost: DataFrame, path: str) -> None:
    """Appends one JSON object a cost record."""
    cost.write.mode("append").json(path)


def read_cost_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Cost records of ``write_cost_jsonl``."""
    return spark.read.schema(schema).json(path)


def cost_keyed_records(cost: DataFrame) -> DataFrame:
    """``cost`` with partition and sort keys, three index key pairs, expiry after a year and unix seconds."""
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    of = lambda name, column: F.concat(F.lit(f"{name}#"), column)
    return cost.withColumns(
        {
            "pk": of("COST", F.date_format("ts", "yyyy-MM-dd")),
            "sk": F.concat(F.lit("TIMESTAMP#"), stamp, F.lit("#"), F.col("request_id").cast("string")),
            "idx1pk": of("PROVIDER", F.col("provider")), "idx1sk": of("MODEL", F.col("model")),
            "idx2pk": of("USER", F.col("user_id")), "idx2sk": of("PROVIDER", F.col("provider")),
            "idx3pk": of("MODEL", F.col("model")), "idx3sk": of("PROVIDER", F.col("provider")),
            "ttl": F.unix_seconds((F.col("ts") + F.expr("INTERVAL 1 YEAR")).cast("timestamp")),
            "ts_unix": F.unix_seconds(F.col("ts").cast("timestamp")),
        }
    )


def cost_metric_points(cost: DataFrame, tags: tuple[str, ...] = ()) -> DataFrame:
    """(request_id, metric, value, tags): tokens, cents and a count per record; a tag is there where its column is not empty."""
    cents = lambda c: F.col(c) / F.lit(100.0)
    points = {"tokens.input": F.col("input_tokens").cast("double"), "tokens.output": F.col("output_tokens").cast("double"), "tokens.total": (F.col("input_tokens") + F.col("output_tokens")).cast("double"), "cost.input_cents": cents("input_e4"), "cost.output_cents": cents("output_e4"), "cost.total_cents": cents("total_e4"), "requests.count": F.lit(1.0)}
    every = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), v.alias("value")) for n, v in points.items()])).alias("p")
    tagged = F.array_compact(F.array(*[F.when(F.col(t) != "", F.concat(F.lit(f"{t}:"), t)) for t in ("provider", "model", *tags)]))
    return cost.select("request_id", tagged.alias("tags"), every).select("request_id", "p.metric", "p.value", "tags")


def pii_metric_points(scans: DataFrame) -> DataFrame:
    """(metric, provider, tag, value): scans by outcome and entities by type; empty tags are ``unknown``, long ones are cut."""
    clean = lambda c: F.substring(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown")), 1, 200)
    outcomes = scans.groupBy(clean("provider").alias("provider"), clean("outcome").alias("tag")).agg(F.count("*").alias("value")).withColumn("metric", F.lit("pii.scans"))
    entities = scans.select(clean("provider").alias("provider"), F.explode("entity_counts").alias("tag", "n")).groupBy("provider", "tag").agg(F.sum("n").cast("long").alias("value")).withColumn("metric", F.lit("pii.entities"))
    return outcomes.unionByName(entities).select("metric", "provider", "tag", "value")
