"""The staged pipeline over one dataset: each stage is written once to the shared folder and read from there."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accesslens.operators import alerts as al
from accesslens.operators import classify as cl
from accesslens.operators import detect as de
from accesslens.operators import explain as ex
from accesslens.operators import features as fe
from accesslens.operators import profiles as pr
from accesslens.operators.scan import SkewConfig
from accesslens.session import configure, listing, work_path
from accesslens.sources import fixtures


class Pipeline:
    """Stage tables of one dataset, as the stages hand them over to each other.

    A stage is computed on first use, written as parquet, and read back with its
    columns pruned by whoever needs it. Nothing is kept in memory.
    """

    _open: dict[tuple[str, str, str], "Pipeline"] = {}

    def __init__(self, spark: SparkSession, sf_dir: str, skew: SkewConfig | None = None) -> None:
        self.rows = fixtures.size(spark, sf_dir.rstrip("/"))
        self.spark = configure(spark, self.rows)
        self.sf_dir = sf_dir.rstrip("/")
        self.skew = skew or SkewConfig()
        self._paths: dict[str, str] = {}
        self._schemas: dict[str, object] = {}
        self._builds: tuple[datetime, datetime] | None = None

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> "Pipeline":
        """The pipeline of this application and dataset as it is now, so that queries share its stages."""
        key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), listing(spark, sf_dir))
        if key not in cls._open:
            cls._open[key] = cls(spark, sf_dir)
        pipeline = cls._open[key]
        pipeline.spark = configure(spark, pipeline.rows)
        return pipeline

    def path(self, name: str) -> str:
        """A fresh path for output of this pipeline."""
        return work_path(self.spark, name)

    def stage(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._paths:
            df, path = build(), self.path(name)
            df.write.parquet(path)
            self._paths[name], self._schemas[name] = path, df.schema
        return self.spark.read.schema(self._schemas[name]).parquet(self._paths[name])

    def once(self, name: str, write: Callable[[str], object]) -> str:
        """A path written once by ``write``."""
        if name not in self._paths:
            path = self.path(name)
            write(path)
            self._paths[name] = path
        return self._paths[name]

    # ---- sources ----

    def labelled(self) -> DataFrame:
        return fixtures.labelled_events(self.spark, self.sf_dir)

    def events(self) -> DataFrame:
        return fixtures.events(self.spark, self.sf_dir)

    def entities(self) -> DataFrame:
        return fixtures.entities(self.spark, self.sf_dir)

    def truth(self) -> DataFrame:
        return fixtures.ground_truth(self.spark, self.sf_dir)

    def triage(self) -> DataFrame:
        return fixtures.triage_status(self.spark, self.sf_dir)

    def builds(self) -> tuple[datetime, datetime]:
        """When the two profile versions are built, in UTC: halfway through the days of the events, and after the last one.

        The first is learned from the events before it, the second from all.
        """
        if self._builds is None:
            day = 86_400_000_000
            span = self.events().agg(F.min(F.unix_micros("timestamp")).alias("low"), F.max(F.unix_micros("timestamp")).alias("high")).first()
            low, high = (span.low or 0) // day, (span.high or 0) // day + 1
            at = [datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(days=d) for d in (low + (high - low) // 2, high)]
            self._builds = (at[0], at[1])
        return self._builds

    # ---- stages ----

    def engineered(self) -> DataFrame:
        def build() -> DataFrame:
            features = fe.engineer_features(self.events(), self.entities(), skew=self.skew)
            return fe.join_ground_truth(features, self.truth())

        return self.stage("engineered", build)

    def store_path(self) -> str:
        def write(path: str) -> None:
            engineered, entities = self.engineered(), self.entities()
            first, second = self.builds()
            early = engineered.filter(F.col("timestamp") < F.lit(first))
            pr.sink_profiles_append(pr.build_profiles(early, entities, first, skew=self.skew), path)
            before = pr.scan_profiles_latest(pr.scan_store(self.spark, path))
            # ``before`` lists the files of the first version, so appending the second leaves it as it is.
            pr.sink_profiles_append(pr.build_profiles(engineered, entities, second, before, skew=self.skew), path)

        return self.once("store", write)

    def store(self) -> pr.Profiles:
        return pr.scan_store(self.spark, self.store_path())

    def latest(self) -> pr.Profiles:
        return pr.scan_profiles_latest(self.store())

    def detection(self) -> DataFrame:
        return self.stage("detection", lambda: de.detect(self.engineered(), self.latest(), skew=self.skew))

    def evidence(self) -> DataFrame:
        return self.stage(
            "evidence",
            lambda: cl.evidence_bundle(self.detection(), self.engineered(), self.store(), self.latest(), self.skew),
        )

    def classified(self) -> DataFrame:
        return self.stage("classified", lambda: cl.classify(self.evidence(), self.truth()))

    def explain_inputs(self) -> DataFrame:
        return ex.explain_evidence(
            self.classified(), self.detection(), self.engineered(), self.store(), self.latest(), self.skew
        )

    def explained(self) -> DataFrame:
        return self.stage("explained", lambda: ex.explain(self.explain_inputs()))

    def alerts(self) -> DataFrame:
        return self.stage(
            "alerts",
            lambda: al.build_alerts(
                self.classified(), self.detection(), self.explained(), self.engineered(), self.entities(), self.latest(),
            ),
        )
