"""Column roles of telemetry frames, and the fixed vocabularies the rest of the library refers to."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# --- Fixed values: quality codes -------------------------------------------------------------------------------------
NORMAL, SUSPICIOUS, BAD, VERY_BAD, FILLED, OUTLIER = 0, 1, 2, 3, 4, 5

# --- Fixed values: study range, default limits -----------------------------------------------------------------------
START_DATE = "2018-08-01"
END_DATE = "2025-10-05"
GRID_STEP = 15 * 60
MAX_FILL_STEPS = 96
LAGS = (6, 12, 24, 48)
ROLLING_WINDOWS = (24, 48, 72, 168)
SUM_WINDOWS = (96, 672, 2880)

# --- Fixed values: column names of the station telemetry -------------------------------------------------------------
KEY = "codigoestacao"
TS = "Data_Hora_Medicao"
UPDATED = "Data_Atualizacao"
STATUS_SUFFIX = "_Status"
SIGNED = ("Temperatura_Interna",)
METADATA = ("Altitude", "Area_Drenagem", "Latitude", "Longitude", "Rio_Codigo")
STAGE_VALUES = ("Cota_Adotada", "Chuva_Adotada", "Temperatura_Interna", "Vazao_Adotada")
FALLBACK = {"Cota_Adotada": "Cota_Manual"}
RESAMPLE_RULES = {
    **{name: "mean" for name in STAGE_VALUES},
    **{name + STATUS_SUFFIX: "max" for name in STAGE_VALUES},
    **{name: "first" for name in METADATA},
}
ENGINEERED_PREFIXES = ("lag_", "rolling_mean_", "rolling_std_", "cum_sum_")
DATE_NAMES = ("date", "datetime", "timestamp", "data_hora_medicao", "data_hora")
LABEL_COLUMNS = ("target", "model_name", "split")

# --- Fixed values: stations of the study and their backup ------------------------------------------------------------
STATION_NAMES = {
    "87450004": "Guaíba (CAIS MAUÁ C6 + USINA DO GASÔMETRO)",
    "85900000": "Jacuí (RIO PARDO)",
    "87399000": "Gravataí (PASSO DAS CANOAS - AUXILIAR)",
    "86510000": "Taquari (MUÇUM)",
    "86720000": "Taquari (ENCANTADO)",
    "87382000": "Sinos (SÃO LEOPOLDO)",
    "87380000": "Sinos (CAMPO BOM)",
    "87150000": "Caí (LINHA GONZAGA)",
    "87170000": "Caí (BARCA DO CAÍ)",
}
STATION_ALIASES = {"87444000": "87450004"}
RIVER_CODES = ("87200000", "86001000", "87220000", "87240000", "87230000", "85001000")

# --- Fixed values: federative units ----------------------------------------------------------------------------------
STATE_NAMES = {
    "AC": "Acre",
    "AL": "Alagoas",
    "AP": "Amapá",
    "AM": "Amazonas",
    "BA": "Bahia",
    "CE": "Ceará",
    "DF": "Distrito Federal",
    "ES": "Espírito Santo",
    "GO": "Goiás",
    "MA": "Maranhão",
    "MT": "Mato Grosso",
    "MS": "Mato Grosso do Sul",
    "MG": "Minas Gerais",
    "PA": "Pará",
    "PB": "Paraíba",
    "PR": "Paraná",
    "PE": "Pernambuco",
    "PI": "Piauí",
    "RJ": "Rio de Janeiro",
    "RN": "Rio Grande do Norte",
    "RS": "Rio Grande do Sul",
    "RO": "Rondônia",
    "RR": "Roraima",
    "SC": "Santa Catarina",
    "SP": "São Paulo",
    "SE": "Sergipe",
    "TO": "Tocantins",
}

# --- Fixed values: endpoint names of the telemetry service -----------------------------------------------------------
CHUNKED_ENDPOINTS = (
    "HidrosatSerieDados",
    "HidroSerieVazao",
    "HidroSerieSedimentos",
    "HidroSerieResumoDescarga",
    "HidroSerieQA",
    "HidroSeriePerfilTransversal",
    "HidroSerieGranulometria",
    "HidroSerieCurvaDescarga",
    "HidroSerieCotas",
    "HidroSerieChuva",
    "HidroinfoanaSerieTelemetricaDetalhada_v1",
    "HidroinfoanaSerieTelemetricaDetalhada_v2",
    "HidroinfoanaSerieTelemetricaAdotada_v1",
    "HidroinfoanaSerieTelemetricaAdotada_v2",
)
ONE_SHOT_ENDPOINTS = (
    "HidroUF",
    "HidroSubBacia",
    "HidroRio",
    "HidroMunicipio",
    "HidroInventarioEstacoes",
    "HidroEntidade",
    "HidroBacia",
)
SPAN_DAYS = (30, 21, 14, 7, 2)
SPAN_LABEL = "DIAS_"


@dataclass(frozen=True)
class SeriesSchema:
    """Which columns of a frame identify a series, order it, carry values and carry quality codes."""

    key: str = KEY
    ts: str = TS
    values: tuple[str, ...] = STAGE_VALUES
    meta: tuple[str, ...] = METADATA
    signed: tuple[str, ...] = SIGNED
    status_suffix: str = STATUS_SUFFIX
    categories: tuple[str, ...] = ("Rio_Codigo",)

    def status(self, value: str) -> str:
        return value + self.status_suffix

    def kept(self, columns: list[str]) -> list[str]:
        """The declared columns that exist, in the declared order."""
        wanted = [self.ts, self.key]
        for value in self.values:
            wanted += [value, self.status(value)]
        return [name for name in [*wanted, *self.meta] if name in columns]


def is_status(name: str) -> bool:
    return STATUS_SUFFIX in name


def numeric_columns(columns: list[str], target: str | None = None, schema: SeriesSchema = SeriesSchema()) -> list[str]:
    """Columns to impute and scale: not a status, not metadata, not a category, not the timestamp, not the target."""
    skip = (*schema.meta, *schema.categories, schema.ts)
    return [c for c in columns if schema.status_suffix not in c and not c.startswith(skip) and c != target]


def categorical_columns(columns: list[str], target: str | None = None, schema: SeriesSchema = SeriesSchema()) -> list[str]:
    """Columns to one-hot encode: status codes and categories such as river codes."""
    return [c for c in columns if (schema.status_suffix in c or c.startswith(schema.categories)) and c != target]


def feature_columns(schema: T.StructType) -> list[str]:
    """Numeric columns that may be lagged, rolled or accumulated."""
    barred = tuple(p.lower() for p in METADATA) + (KEY,)

    def eligible(field: T.StructField) -> bool:
        name = field.name.lower()
        return (
            isinstance(field.dataType, T.NumericType)
            and name not in DATE_NAMES
            and not field.name.startswith(ENGINEERED_PREFIXES)
            and STATUS_SUFFIX.lower() not in name
            and not name.startswith(barred)
        )

    return [f.name for f in schema.fields if eligible(f)]


def imputable_columns(columns: list[str]) -> list[str]:
    """Wide columns the gap spline may fill."""
    skip = (*METADATA, TS, "date")
    return [c for c in columns if not is_status(c) and not c.startswith(skip) and c not in LABEL_COLUMNS]
