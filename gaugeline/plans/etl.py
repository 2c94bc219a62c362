"""Raw telemetry to the wide hourly frame."""

from __future__ import annotations

from pyspark.sql import DataFrame

from gaugeline import schema as S
from gaugeline.operators.clean import clean, merge_aliases, rename_key
from gaugeline.operators.impute import fill_gaps
from gaugeline.operators.outliers import remove_outliers
from gaugeline.operators.resample import resample
from gaugeline.operators.reshape import wide_frame
from gaugeline.schema import SeriesSchema
from gaugeline.session import checkpointed
from gaugeline.sources.tables import save_stage, scan_stations


def build(
    raw: DataFrame,
    inventory: DataFrame | None = None,
    schema: SeriesSchema = SeriesSchema(),
    stations: list[str] | None = None,
    aliases: dict[str, str] | None = None,
    frequency: str = "h",
    max_fill_steps: int = S.MAX_FILL_STEPS,
    lo: str = S.START_DATE,
    hi: str = S.END_DATE,
    step: int = S.GRID_STEP,
    method: str = "iqr",
    rules: dict[str, str] | None = None,
    names: list[str] | None = None,
    folder: str | None = None,
    fallback: dict[str, str] | None = None,
) -> dict[str, DataFrame]:
    """All stages: cleaned, filled, missing, outlier, aggregated, melted.

    With ``folder`` each stage is written there and the next one reads the files, which also saves the results. Without
    it, only the filled stage is checkpointed, because the outlier scores read it several times.
    """

    def kept(df: DataFrame, stage: str) -> DataFrame:
        return save_stage(df, folder, stage) if folder else df

    key, ts = schema.key, schema.ts
    source = rename_key(raw, key)
    if stations is not None:
        source = scan_stations(source, stations, key)
    source = merge_aliases(source, S.STATION_ALIASES if aliases is None else aliases, key, ts)
    cleaned = kept(clean(source, schema, lo, hi, fallback), "cleaned")
    filled, missing = fill_gaps(cleaned, schema, lo, hi, step, max_fill_steps, meta=inventory)
    filled = save_stage(filled, folder, "filled") if folder else checkpointed(filled)
    outlier = kept(remove_outliers(filled, schema, method), "outlier")
    aggregated = kept(resample(outlier, key, ts, frequency, rules or S.RESAMPLE_RULES), "aggregated")
    melted = kept(wide_frame(aggregated, key, ts, names), "melted")
    return {
        "cleaned": cleaned,
        "filled": filled,
        "missing": kept(missing, "missing"),
        "outlier": outlier,
        "aggregated": aggregated,
        "melted": melted,
    }
