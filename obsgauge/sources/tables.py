"""The star-schema test tables seen as telemetry.

Each method is a narrow projection: columns that need a further join (span
name, span time) are only added when asked for, so a query that does not use
them neither reads nor shuffles them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from obsgauge.functions.attributes import label_key, normalize_severity, service_of
from obsgauge.functions.timebins import plus_seconds


class Tables:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        # The tables' times carry no zone; the session's other settings are left alone.
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark = spark
        self.folder = folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # Buckets 0-5 are configured services, 6 kept the SDK default name, 7 has no name.
    @staticmethod
    def _service_name(bucket: Column) -> Column:
        return (F.when(bucket <= 5, F.concat(F.lit("svc-"), bucket.cast("string")))
                .when(bucket == 6, F.lit("unknown_service:java")))

    @staticmethod
    def _environment(bucket: Column) -> Column:
        return F.when(bucket <= 2, F.lit("production")).when(bucket <= 5, F.lit("staging"))

    @staticmethod
    def _resource(name: Column, environment: Column, version: Column | None = None) -> Column:
        flat = [F.lit("service.name"), name, F.lit("deployment.environment.name"), environment]
        if version is not None:
            flat += [F.lit("service.version"), version]
        return F.create_map(*flat)

    def spans(self, names: bool = False, times: bool = False, tasks: int | None = None) -> DataFrame:
        """Every line item is a span: trace = order, parent = the line before; (order, line) may repeat, as ids do.

        ``tasks`` says to how many tasks the lines are dealt by trace; they are then not put together again by their bytes, which
        compress to a few for each row.
        """
        lines = self.read("lineitem").select(
            "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_returnflag", "l_linestatus")
        per_span = lines.select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("_s"), F.col("l_partkey").alias("_p"),
                                F.col("l_returnflag").alias("_r"), F.col("l_linestatus").alias("_l"))
        bucket = F.col("_s") % 8
        name = self._service_name(bucket)
        version = F.concat(F.lit("v"), (F.col("l_linenumber") % (bucket + 1)).cast("string"))
        out = [
            F.col("l_orderkey").alias("trace_id"), F.col("l_linenumber").alias("span_id"),
            F.when(F.col("l_linenumber") > 1, F.col("l_linenumber") - 1).alias("parent_span_id"),
            service_of(name).alias("service"),
            self._resource(name, self._environment(bucket), version).alias("resource"),
            F.when(F.col("_r") == "R", "client").when(F.col("_r") == "A", "server").otherwise("internal").alias("kind"),
            F.when(F.col("_l") == "F", "error").otherwise("ok").alias("status"),
            F.create_map().cast("map<string,string>").alias("attrs"),
            F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "_p", "_s")]).alias("item_id"),
        ]
        df = per_span if tasks is None else per_span.repartition(tasks, "l_orderkey")
        if times:
            orders = self.read("orders").select(F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp").alias("ts"))
            df = df.join(orders, df.l_orderkey == orders.o_orderkey)
            out.append(F.col("ts"))
        if names:
            part = self.read("part").select("p_partkey", "p_name")
            df = df.join(part, df["_p"] == part.p_partkey)
            out.append(F.col("p_name").alias("name"))
        return df.select(*out)

    def _events(self) -> DataFrame:
        bucket = F.col("user_id") % 8
        name = self._service_name(bucket)
        return self.read("events").select(
            "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value",
            bucket.alias("bucket"), service_of(name).alias("service"),
            self._resource(name, self._environment(bucket)).alias("resource"),
            F.regexp_extract("props", "[0-9]+", 0).alias("number"), F.length("props").alias("props_len"))

    @staticmethod
    def _by_type(cases: dict, default) -> Column:
        out = None
        for kind, value in cases.items():
            branch = (F.col("event_type") == kind, F.lit(value))
            out = F.when(*branch) if out is None else out.when(*branch)
        return out.otherwise(F.lit(default))

    def logs(self) -> DataFrame:
        """Every event as a log record; some state severity as text only, some not at all."""
        number = self._by_type({"view": 9, "error": 17}, 0)
        text = self._by_type({"click": "debug", "purchase": "WARNING"}, "")
        return self._events().select(
            F.col("event_id"), "ts", "service", "resource", text.alias("severity_text"),
            normalize_severity(number, text).alias("severity_number"),
            (F.col("number").cast("int") % 8 >= F.col("bucket")).alias("has_trace_id"),
            F.col("props_len").alias("body_len"), F.create_map().cast("map<string,string>").alias("attrs"),
            F.col("event_id").cast("string").alias("item_id"))

    def points(self) -> DataFrame:
        """Every event as a metric data point; sign-ups are histograms in three layouts."""
        kind = self._by_type({"signup": "histogram", "view": "gauge"}, "sum")
        layout = F.col("number").cast("int") % 3
        bounds = (F.when(layout == 0, F.array().cast("array<double>"))
                  .when(layout == 1, F.array(*[F.lit(x) for x in (0.1, 0.5, 1.0)]))
                  .otherwise(F.array(F.lit(1.0), F.lit(5.0))))
        return self._events().select(
            F.col("event_id"), "ts", "service", "resource",
            self._by_type({"click": "http.requests", "view": "page.view.seconds", "purchase": "purchase_bytes_total",
                           "error": "errors"}, "request.duration").alias("name"),
            kind.alias("type"), self._by_type({"error": "", "view": "s"}, "1").alias("unit"),
            F.create_map(F.lit("k"), F.col("number")).alias("attrs"),
            F.when(F.col("event_type") == "signup", bounds).alias("bucket_bounds"),
            F.when((F.col("event_type") == "signup") & (F.col("value") > 100), 1).otherwise(0).alias("exemplar_count"),
            "value", F.col("event_id").cast("string").alias("item_id"))

    def signals(self, names: bool = False, times: bool = False) -> dict[str, DataFrame]:
        return {"span": self.spans(names, times), "metric": self.points(), "log": self.logs()}

    def backend_samples(self) -> DataFrame:
        """Points as backend series: (metric, labels, series_key)."""
        df = self.points().select(F.col("name").alias("metric"), F.create_map(
            F.lit("__name__"), F.col("name"), F.lit("k"), F.col("attrs")["k"],
            F.lit("service_name"), F.col("service")).alias("labels"))
        return df.withColumn("series_key", label_key(F.col("labels")))

    def jobs(self) -> DataFrame:
        env = F.col("resource")["deployment.environment.name"]
        return (self.points().where(env.isNotNull())
                .select(F.concat(env, F.lit("/"), F.col("service")).alias("job")).distinct())

    def samples(self) -> DataFrame:
        """Hourly cumulative request and error counters per service."""
        hourly = self.logs().groupBy("service", F.date_trunc("hour", "ts").alias("ts")).agg(
            F.count(F.lit(1)).alias("_n"), F.count_if(F.col("severity_number") == 17).alias("_e"))
        upto = Window.partitionBy("service").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
        return hourly.select("service", "ts", F.sum("_n").over(upto).alias("requests_total"),
                             F.sum("_e").over(upto).alias("errors_total"))

    def incidents(self) -> DataFrame:
        """An incident at every 31st event: from half a minute to nine days long, some sixty days after everything; a third names the rule that should fire, a third another."""
        id_ = F.col("event_id")
        seconds = F.element_at(F.array(*[F.lit(s) for s in (30, 3 * 3600, 12 * 3600, 2 * 86400, 9 * 86400)]), (id_ % 5 + 1).cast("int"))
        start = plus_seconds(F.date_trunc("hour", "ts"), F.when(id_ % 11 == 0, 60 * 86400).otherwise(0))
        alert = (F.when(id_ % 3 == 1, F.array(F.lit("HighErr"))).when(id_ % 3 == 2, F.array(F.lit("OtherRule")))
                 .otherwise(F.array().cast("array<string>")))
        return (self.read("events").where(id_ % 31 == 0)
                .select(F.concat(F.lit("inc-"), id_.cast("string")).alias("incident"), start.alias("start_ts"), plus_seconds(start, seconds).alias("end_ts"),
                        alert.alias("expected_alerts")))

    def usage(self) -> DataFrame:
        third = F.col("doc_id") % 3
        return self.read("documents").select(
            F.col("source").alias("service"), F.col("lang").alias("team"),
            F.when(third == 0, "metrics").when(third == 1, "logs").otherwise("traces").alias("signal"),
            (F.col("n_chars").cast("bigint") * 1_000_000).alias("ingest_bytes"),
            F.when(third == 0, F.col("n_chars") * 100).otherwise(F.lit(0)).cast("bigint").alias("active_series"))

    def objects(self) -> DataFrame:
        fourth = F.col("page_id") % 4
        return self.read("pages").select(
            F.when(fourth == 0, "").when(fourth == 1, "STANDARD").when(fourth == 2, "STANDARD_IA")
            .otherwise("GLACIER_IR").alias("storage_class"),
            (F.length("html").cast("bigint") * 1_000_000).alias("bytes"))

    def truth(self) -> DataFrame:
        return self.read("lineitem").where(F.col("l_returnflag") == "R").select(
            F.col("l_orderkey").alias("scenario"), F.lit("Deployment").alias("kind"), F.lit("shop").alias("namespace"),
            F.concat(F.lit("supp-"), F.col("l_suppkey").cast("string")).alias("name"))

    def diagnosis(self) -> DataFrame:
        return self.read("lineitem").where(F.col("l_linestatus") == "O").select(
            F.col("l_orderkey").alias("scenario"), F.lit(" deployment").alias("kind"), F.lit("Shop").alias("namespace"),
            F.concat(F.lit("SUPP-"), F.col("l_suppkey").cast("string")).alias("name"))

    def run_samples(self) -> DataFrame:
        """Ten-minute collector samples, one run per service; the item counter restarts every day."""
        tick = F.timestamp_micros(F.floor(F.unix_micros("ts") / 600_000_000).cast("bigint") * 600_000_000)
        per_tick = self.points().groupBy(F.col("service").alias("run"), tick.alias("ts")).agg(
            F.max("value").alias("rss"), F.countDistinct(F.col("attrs")["k"]).alias("pairs"),
            F.count_if(F.col("name") == "errors").alias("_e"), F.count(F.lit(1)).alias("_n"))
        day = Window.partitionBy("run", F.to_date("ts")).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
        return per_tick.select("run", "ts", "rss", F.col("pairs").cast("double").alias("pairs"),
                               F.sum("_e").over(day).cast("double").alias("evictions"),
                               F.sum("_n").over(day).cast("double").alias("items"))

    def report_snapshots(self) -> DataFrame:
        """Daily totals as stored cost snapshots."""
        return self.read("orders").groupBy(F.col("o_orderdate").cast("timestamp").alias("taken_at")).agg(
            F.count(F.lit(1)).alias("lines"), F.sum(F.floor("o_totalprice")).cast("bigint").alias("total"))
