"""Shared pieces of the registered queries: table loading, the derived views
every query starts from, and output normalisation.

Doubles in query outputs are rounded to 6 decimals by one fixed rule (and
the SQL oracles use the same expression), so engine-specific last-bit
differences of sums, means and percentile interpolation do not show up as
mismatches, not even for a mean sitting exactly on a rounding tie.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewise.sources import fixtures
from tracewise.sources.tables import read_table

ROUND_DIGITS = 6


def finish(df: DataFrame, digits: int = ROUND_DIGITS) -> DataFrame:
    """Round every double column (top level) to ``digits``.

    The value is settled to 9 decimals first (absorbing last-bit noise of
    summation order), then rounded by ``round(x * 10^d) / 10^d``, half away
    from zero on one and the same double -- the oracles use the identical
    expression, so a mean sitting exactly on a tie prints the same."""
    scale = float(10 ** digits)
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            settled = F.round(F.col(f.name).cast("double"), 9)
            cols.append((F.round(settled * F.lit(scale)) / F.lit(scale)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage of a stage table by a reliable checkpoint into the
    shared ``spark.checkpoint.dir`` (the stored traces / metrics /
    regressions / reports tables of a pipeline run)."""
    from tracewise.session import checkpoint_dir
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Views:
    """Lazily built derived views over one test-data folder.

    The stage tables (traces, metric points, regressions, reports) are
    materialised once per session and folder, as a pipeline run stores them,
    so later queries read them instead of re-deriving them.
    """

    _stored: dict = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._memo: dict = {}

    def _stage(self, key, build):
        k = (self.spark.sparkContext.applicationId, self.sf_dir, key)
        if k not in Views._stored:
            Views._stored[k] = materialize(build())
        return Views._stored[k]

    @classmethod
    def forget(cls):
        cls._stored.clear()

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    def _get(self, key, build):
        if key not in self._memo:
            self._memo[key] = build()
        return self._memo[key]

    @property
    def ev(self) -> DataFrame:
        return self._get("ev", lambda: fixtures.stage_events(self.table("events")))

    @property
    def tr(self) -> DataFrame:
        from tracewise.operators.traces import assemble_traces
        return self._stage("tr", lambda: assemble_traces(self.ev))

    @property
    def mts(self) -> DataFrame:
        from tracewise.operators.metrics import metrics_long
        return self._stage("mts", lambda: metrics_long(self.tr, self.ev))

    @property
    def cfg(self) -> DataFrame:
        from tracewise.sources.lookups import detection_config
        return self._get("cfg", lambda: detection_config(self.spark, FIXTURE_DETECTION_CONFIG))

    @property
    def reg(self) -> DataFrame:
        from tracewise.operators.regression import detect_all
        return self._stage("reg", lambda: detect_all(self.mts, self.cfg, window_minutes=1440))

    @property
    def rca(self) -> DataFrame:
        from tracewise.operators.rca import rca_reports
        return self._stage("rca", lambda: rca_reports(self.reg))

    @property
    def turns(self) -> DataFrame:
        return self._stage("turns", lambda: fixtures.turns(self.table("conversations")))

    @property
    def calib(self) -> DataFrame:
        return self._get("calib", lambda: fixtures.calibration(self.table("documents"),
                                                               self.table("labels")))

    @property
    def chunks(self) -> DataFrame:
        from tracewise.operators.retrieval import chunk_documents
        return self._get("chunks", lambda: chunk_documents(
            self.table("documents").select("doc_id", "source", "text"),
            separator="\n", min_len=200))

    @property
    def questions(self) -> DataFrame:
        return self._get("questions", lambda: fixtures.questions(self.table("benchmark")))


# ---- fixed values: detection config of the test fixture ------------------
# (metric, threshold, direction) tuned to the fixture's 1440-minute metrics.
FIXTURE_DETECTION_CONFIG = [
    ("error_rate_pct", 45.0, "above"),
    ("latency_p95_ms", 330.0, "above"),
    ("stage_latency_avg_ms:purchase", 52.0, "above"),
]
# Stage order of the fixture's pipeline (event types as stages).
FIXTURE_STAGE_ORDER = ["signup", "view", "click", "purchase", "error"]
# ---------------------------------------------------------------------------
