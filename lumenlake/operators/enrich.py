"""Enrichment jobs: user stages over rows with failures kept per row."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


@dataclass(frozen=True)
class ItemStage:
    """A stage run on one value: `run(value)` or, with `setup`, `run(value, resource)`."""

    name: str
    run: Callable[..., Any]
    setup: Callable[[], Any] | None = None


@dataclass(frozen=True)
class BatchStage:
    """A stage run on a list of values; it must return one result per value."""

    name: str
    run: Callable[..., Sequence[Any]]
    batch_size: int = 32
    setup: Callable[[], Any] | None = None

    def __post_init__(self) -> None:
        if self.batch_size <= 0:
            raise ValueError("batch_size must be positive")


@dataclass
class _Item:
    value: Any
    error: str | None = None
    stage: str | None = None

    def fail(self, stage: str, e: BaseException) -> None:
        kind, text = type(e).__name__, str(e)
        self.value, self.error, self.stage = None, f"{kind}: {text}" if text else kind, stage


class WrongResultCount(ValueError):
    """A batch stage broke its contract: it did not return one result per value. This ends the job, not the rows."""


@dataclass
class _Worker:
    """The stages of one task; a stage's resource is made at its first use."""

    stages: Sequence[ItemStage | BatchStage]
    resources: dict[int, Any] = field(default_factory=dict)

    def _args(self, i: int) -> tuple:
        stage = self.stages[i]
        if stage.setup is None:
            return ()
        if i not in self.resources:
            self.resources[i] = stage.setup()
        return (self.resources[i],)

    def process(self, items: list[_Item]) -> None:
        for i, stage in enumerate(self.stages):
            live = [item for item in items if item.error is None]
            size = stage.batch_size if isinstance(stage, BatchStage) else 1
            for at in range(0, len(live), size):
                group = live[at : at + size]
                try:
                    args = self._args(i)
                    if isinstance(stage, BatchStage):
                        out = list(stage.run([item.value for item in group], *args))
                        if len(out) != len(group):
                            raise WrongResultCount(f"stage {stage.name}: {len(out)} results for {len(group)} values")
                    else:
                        out = [stage.run(group[0].value, *args)]
                except WrongResultCount:
                    raise
                except Exception as e:  # noqa: BLE001 - any other failure belongs to its rows
                    for item in group:
                        item.fail(stage.name, e)
                else:
                    for item, value in zip(group, out):
                        item.value = value


def run_stages(rows: DataFrame, key: str, value: str, stages: Sequence[ItemStage | BatchStage], result_type: str) -> DataFrame:
    """(key, value, error, stage): one result per row, in the rows' own partitions (H1).

    A failing value is reported as `Type: message`, or the type alone where there is no
    message, with its stage; a failing batch fails all its rows and no others. A batch
    stage that returns another number of results ends the job. Stages see values as
    Python objects of the column's own type: a null is None, a whole number stays one.
    """
    if not stages:
        raise ValueError("a job needs at least one stage")
    out_type = T.DataType.fromDDL(result_type)
    schema = T.StructType([
        T.StructField(key, rows.schema[key].dataType), T.StructField("value", out_type),
        T.StructField("error", T.StringType()), T.StructField("stage", T.StringType()),
    ])

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = _Worker(stages)
        for batch in batches:
            items = [_Item(v) for v in batch.column(value).to_pylist()]
            worker.process(items)
            columns = [[i.value for i in items], [i.error for i in items], [i.stage for i in items]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(key).cast(arrow.field(0).type), *[pa.array(c, arrow.field(i).type) for i, c in enumerate(columns, 1)]], schema=arrow)

    return rows.select(key, value).mapInArrow(run, schema)


def job_summary(results: DataFrame, by_stage: bool = False) -> DataFrame:
    """Totals of a job (D18): completed = succeeded + failed; optionally failures per stage."""
    if by_stage:
        return results.where("error IS NOT NULL").groupBy("stage").agg(F.count(F.lit(1)).alias("failed"))
    return results.agg(
        F.count(F.lit(1)).alias("completed"),
        F.count_if(F.col("error").isNull()).alias("succeeded"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
    )


# --- fixed values: registered feature models (H2) ---------------------------------------------
_IMAGENET_MEAN, _IMAGENET_STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
_HALF = (0.5, 0.5, 0.5)
DEFAULT_MODEL = "siglip_base_patch16_224"
# (name, dimension, input size, resize size, channel means, channel deviations, resize mode)
MODELS = (
    ("vit_b_16", 768, 224, 256, _IMAGENET_MEAN, _IMAGENET_STD, "shorter_side_crop"),
    ("dinov2_vitb14", 768, 224, 256, _IMAGENET_MEAN, _IMAGENET_STD, "shorter_side_crop"),
    ("dinov2_vitb14_reg4", 768, 224, 256, _IMAGENET_MEAN, _IMAGENET_STD, "shorter_side_crop"),
    ("siglip_base_patch16_224", 768, 224, 224, _HALF, _HALF, "resize"),
)
# --------------------------------------------------------------------------------------------------
MODEL_FILE_SUFFIX = "_features.onnx"


def model_table(spark: SparkSession) -> DataFrame:
    """The registered models as a small parameter table."""
    schema = (
        "name string, dimension int, input_size int, resize_size int, "
        "normalize_mean array<double>, normalize_std array<double>, resize_mode string"
    )
    return spark.createDataFrame([tuple(list(v) if isinstance(v, tuple) else v for v in m) for m in MODELS], schema)


def model_dimension(file_name: str) -> int:
    """Vector size of a model by its file name or bare name."""
    name = file_name.removesuffix(MODEL_FILE_SUFFIX)
    dimensions = {m[0]: m[1] for m in MODELS}
    if name not in dimensions:
        raise ValueError(f"unsupported model {file_name!r}; supported: {', '.join(dimensions)}")
    return dimensions[name]
