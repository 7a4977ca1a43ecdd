"""Fixed schemas, column lists and parameters shared by all operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

UNCATEGORISED = "Sin categoría"

# --- fixed values -----------------------------------------------------------
DEFAULT_CATEGORIES = (
    "Sin categoría",
    "Alimentación",
    "Tabaco",
    "Transporte",
    "Vivienda",
    "Servicios",
    "Salud",
    "Educación",
    "Compras",
    "Ocio",
    "Viajes",
    "Bancos/Comisiones",
    "Mascotas",
    "Hogar",
    "Suscripciones",
    "Impuestos",
    "Ahorro/Inversión",
    "Transferencias",
    "Ingresos",
    "Otros",
)
WEEKDAY_NAMES = ("Lun", "Mar", "Mié", "Jue", "Vie", "Sáb", "Dom")
OCCASIONAL_WORDS = ("viaje", "lima", "vacaciones")
# ----------------------------------------------------------------------------

LEDGER = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("fecha", T.DateType()),
        T.StructField("detalle", T.StringType()),
        T.StructField("monto", T.DoubleType()),
        T.StructField("es_gasto", T.BooleanType()),
        T.StructField("es_transferencia_o_abono", T.BooleanType()),
        T.StructField("es_compartido_posible", T.BooleanType()),
        T.StructField("fraccion_mia_sugerida", T.DoubleType()),
        T.StructField("monto_mio_estimado", T.DoubleType()),
        T.StructField("categoria_sugerida", T.StringType()),
        T.StructField("detalle_norm", T.StringType()),
        T.StructField("monto_real", T.DoubleType()),
        T.StructField("categoria", T.StringType()),
        T.StructField("nota_usuario", T.StringType()),
        T.StructField("unique_key", T.StringType()),
    ]
)
LEDGER_COLUMNS = tuple(f.name for f in LEDGER)
LEDGER_TYPES = {f.name: f.dataType for f in LEDGER}

IGNORED = T.StructType(
    [
        T.StructField("unique_key", T.StringType()),
        T.StructField("payload", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)
TOMBSTONES = T.StructType(
    [
        T.StructField("unique_key", T.StringType()),
        T.StructField("deleted_at", T.TimestampType()),
    ]
)
REJECTED = T.StructType(
    [
        T.StructField("source_file", T.StringType()),
        T.StructField("line_no", T.LongType()),
        T.StructField("reason", T.StringType()),
        T.StructField("line", T.StringType()),
    ]
)
EXACT_RULES = T.StructType(
    [
        T.StructField("detalle_norm", T.StringType()),
        T.StructField("categoria", T.StringType()),
    ]
)
# What became of each file of a stream: read, rejected or unreadable.
FILES = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("outcome", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("batch_id", T.LongType()),
    ]
)
CATEGORIES = T.StructType([T.StructField("nombre", T.StringType())])
# Rule order is (ord, since, since_id): hand-written rules carry their list
# position in `ord`; learned rules share one `ord` per run and are ordered
# inside it by the row that taught them, so no global ranking is needed.
MERCHANT_RULES = T.StructType(
    [
        T.StructField("ord", T.LongType()),
        T.StructField("since", T.DateType()),
        T.StructField("since_id", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("categoria", T.StringType()),
    ]
)
# The newest row that taught each merchant rule.
MERCHANT_TEACHERS = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("fecha", T.DateType()),
        T.StructField("id", T.StringType()),
        T.StructField("categoria", T.StringType()),
    ]
)
MASTER = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("fecha", T.DateType()),
        T.StructField("detalle", T.StringType()),
        T.StructField("monto", T.DoubleType()),
        T.StructField("es_transferencia_o_abono", T.BooleanType()),
        T.StructField("es_compartido_posible", T.BooleanType()),
        T.StructField("categoria", T.StringType()),
        T.StructField("fraccion_mia", T.DoubleType()),
        T.StructField("monto_mio", T.DoubleType()),
        T.StructField("detalle_norm", T.StringType()),
        T.StructField("es_entre_cuentas", T.BooleanType()),
        T.StructField("match_id", T.StringType()),
        T.StructField("es_gasto", T.BooleanType()),
    ]
)

FLAG_COLUMNS = ("es_gasto", "es_transferencia_o_abono", "es_compartido_posible")
EDITABLE_COLUMNS = (
    "es_gasto",
    "es_transferencia_o_abono",
    "es_compartido_posible",
    "fraccion_mia_sugerida",
    "monto_mio_estimado",
    "categoria_sugerida",
    "monto_real",
    "categoria",
    "nota_usuario",
)
MONEY = T.DecimalType(18, 2)


@dataclass(frozen=True)
class MatchConfig:
    """Parameters of the master update."""

    account_aliases: tuple[str, ...] = ()
    reimbursement_window_days: int = 21
    reimbursement_amount_tolerance: float = 1000.0
