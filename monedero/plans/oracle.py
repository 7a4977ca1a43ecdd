"""The same results in SQL, written on the raw test tables for DuckDB."""

from __future__ import annotations

from monedero.adapters import MERCHANT_RULES
from monedero.plans.catalog import ALIASES, MONTH
from monedero.schema import OCCASIONAL_WORDS, WEEKDAY_NAMES

# --- shared pieces ----------------------------------------------------------


def _alnum(x: str) -> str:
    return f"upper(trim(regexp_replace({x}, '[^A-Za-z0-9]+', ' ', 'g')))"


def _key(fecha: str, norm: str, monto: str) -> str:
    amount = f"CAST(CAST(abs(coalesce({monto}, 0)) AS DECIMAL(18,2)) AS VARCHAR)"
    day = f"coalesce(strftime({fecha}, '%Y-%m-%d'), 'NaT')"
    return f"'k:' || sha256({day} || '|' || {norm} || '|' || {amount})[1:16]"


def _amt(x: str) -> str:
    return f"CAST(abs(coalesce({x}, 0)) AS DECIMAL(18,2))"


MOV = f"""
mov AS (
  SELECT o_orderkey AS orden, CAST(o_orderkey AS VARCHAR) AS id, CAST(o_orderdate AS DATE) AS fecha,
    c_mktsegment || '*' || CASE WHEN o_orderkey % 31 = 0 THEN 'NEW ' || CAST(o_orderkey AS VARCHAR) ELSE c_name END AS detalle,
    CASE WHEN o_orderstatus = 'P' THEN o_totalprice ELSE -o_totalprice END AS monto,
    o_orderstatus <> 'P' AND o_orderkey % 23 <> 0 AS es_gasto,
    o_orderkey % 23 = 0 AS es_transferencia_o_abono,
    o_custkey % 9 = 0 AS es_compartido_posible,
    CASE WHEN o_custkey % 9 = 0 THEN CAST(0.5 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END AS fraccion_mia_sugerida,
    CASE WHEN o_orderstatus = 'P' THEN CAST(0 AS DOUBLE)
         WHEN o_custkey % 9 = 0 THEN -o_totalprice * CAST(0.5 AS DOUBLE) ELSE -o_totalprice END AS monto_mio_estimado,
    CASE WHEN o_orderkey % 31 = 0 THEN NULL WHEN o_orderkey % 15 = 0 THEN ''
         WHEN o_orderkey % 15 = 5 THEN 'Sin categoría' WHEN o_orderkey % 5 = 0 THEN NULL
         WHEN o_orderkey % 10 < 8 THEN 'Cat' || CAST(o_custkey % 7 AS VARCHAR) ELSE o_orderpriority END AS categoria,
    CASE WHEN o_orderkey % 4 = 0 THEN floor(o_totalprice * CAST(0.75 AS DOUBLE)) WHEN o_orderkey % 4 = 1 THEN CAST(0 AS DOUBLE) END AS monto_real,
    CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS nota_usuario,
    o_orderstatus AS estado, o_orderpriority AS prioridad
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

_LEDGER_COLUMNS = """id, fecha, detalle, monto, es_gasto, es_transferencia_o_abono, es_compartido_posible,
    fraccion_mia_sugerida, monto_mio_estimado, CAST(NULL AS VARCHAR) AS categoria_sugerida,
    detalle_norm, monto_real, categoria, nota_usuario, unique_key"""

LED = f"""{MOV},
keyed AS (SELECT *, lower({_alnum('detalle')}) AS detalle_norm,
    {_key('fecha', f"lower({_alnum('detalle')})", 'monto')} AS unique_key FROM mov),
led AS (SELECT {_LEDGER_COLUMNS}, {_amt('monto')} AS amt, estado, prioridad, orden,
    strftime(fecha, '%Y-%m') AS mes FROM keyed)"""

EVENTS = f"""
ev AS (SELECT CAST(event_id AS VARCHAR) AS id, CAST(ts AS DATE) AS fecha,
    CASE WHEN event_type = 'signup' THEN value ELSE -value END AS monto, event_type AS categoria,
    {_amt('value')} AS amt, strftime(ts, '%Y-%m') AS mes FROM events)"""

ITEMS = f"""
li AS (SELECT CAST(l_shipdate AS DATE) AS fecha, lower({_alnum("p_name || ' ' || p_brand")}) AS detalle_norm,
    {_amt('l_extendedprice')} AS amt, strftime(l_shipdate, '%Y-%m') AS mes
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

COLS = (
    "id, fecha, detalle, monto, es_gasto, es_transferencia_o_abono, es_compartido_posible, "
    "fraccion_mia_sugerida, monto_mio_estimado, categoria_sugerida, detalle_norm, monto_real, "
    "categoria, nota_usuario, unique_key"
)

CATS = """
cats AS (SELECT DISTINCT categoria AS nombre FROM led WHERE categoria LIKE 'Cat%' UNION SELECT 'Sin categoría')"""

XRULES = f"""
xrules AS (SELECT lower({_alnum("c_mktsegment || '*' || c_name")}) AS detalle_norm,
    CASE WHEN c_mktsegment = 'MACHINERY' THEN '' ELSE 'Vivienda' END AS categoria
  FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))"""

_MRULES_VALUES = ", ".join(f"({i}, '{k}', '{c}')" for i, (k, c) in enumerate(MERCHANT_RULES))
MRULES = f"""
mrules AS (SELECT * FROM (VALUES {_MRULES_VALUES}) AS t(ord, key, categoria))"""

MASTER = f"""{MOV},
mast AS (SELECT *, upper(detalle) AS dn, nullif(categoria, '') AS cat, {_amt('monto')} AS amt FROM mov)"""

STORED = f"""
stored AS (SELECT unique_key, detalle_norm FROM led WHERE estado <> 'O'),
deleted AS (SELECT unique_key FROM led WHERE estado = 'O' AND prioridad = '5-LOW'),
ign AS (SELECT unique_key, id, detalle, nota_usuario, categoria, monto, monto_real FROM led
  WHERE estado = 'O' AND prioridad = '3-MEDIUM'),
batch AS (
  SELECT *, orden * 2 AS line_no, nota_usuario AS nota FROM led
  UNION ALL
  SELECT *, orden * 2 + 1, 'repetido' FROM led WHERE prioridad = '1-URGENT')"""

INGEST = f"""{LED}, {STORED}, {XRULES},
filled AS (
  SELECT b.*, coalesce(nullif(coalesce(CASE WHEN trim(b.categoria) NOT IN ('', 'nan', 'None') THEN b.categoria END, r.categoria), ''), 'Sin categoría') AS cat
  FROM batch b LEFT JOIN xrules r ON r.detalle_norm = b.detalle_norm),
alive AS (
  SELECT *, row_number() OVER (PARTITION BY unique_key ORDER BY line_no) AS nth,
    unique_key IN (SELECT unique_key FROM stored) AS held
  FROM filled
  WHERE unique_key NOT IN (SELECT unique_key FROM deleted)
    AND unique_key NOT IN (SELECT unique_key FROM ign))"""

UPSERT = f"""{LED}, {STORED},
alive AS (
  SELECT *, row_number() OVER (PARTITION BY unique_key ORDER BY line_no) AS nth,
    unique_key IN (SELECT unique_key FROM stored) AS held
  FROM batch WHERE unique_key NOT IN (SELECT unique_key FROM ign))"""

PEND = """
pend AS (SELECT * FROM led WHERE (categoria IS NULL OR categoria IN ('', 'Sin categoría')) AND detalle_norm <> '')"""

DOMINANT = """
hcount AS (SELECT detalle_norm, categoria, count(*) AS cnt FROM led
  WHERE categoria IS NOT NULL AND categoria <> 'Sin categoría' GROUP BY ALL),
ranked AS (SELECT *, sum(cnt) OVER (PARTITION BY detalle_norm) AS total,
    row_number() OVER (PARTITION BY detalle_norm ORDER BY cnt DESC, categoria) AS rn FROM hcount),
dominant AS (SELECT detalle_norm, categoria FROM ranked
  WHERE rn = 1 AND cnt * 100.0 / total >= 70 AND trim(categoria) <> '')"""

SIMILAR = """
hist AS (SELECT upper(trim(detalle_norm)) AS name, categoria, amt FROM led
  WHERE categoria IS NOT NULL AND categoria <> 'Sin categoría' AND trim(detalle_norm) <> ''),
ask AS (SELECT DISTINCT upper(trim(detalle_norm)) AS name, amt FROM pend),
meets AS (
  SELECT a.name, a.amt, h.categoria, h.amt AS hamt FROM ask a JOIN hist h ON h.name = a.name
  UNION ALL
  SELECT a.name, a.amt, h.categoria, h.amt FROM ask a JOIN hist h ON contains(h.name, substr(a.name, 1, 4))
  WHERE length(a.name) >= 4 AND a.name NOT IN (SELECT name FROM hist)),
per_cat AS (SELECT name, amt, categoria, count(*) AS n_all,
    count(*) FILTER (WHERE amt > 0 AND hamt BETWEEN amt - greatest(amt * 0.25, 1000) AND amt + greatest(amt * 0.25, 1000)) AS n_in
  FROM meets GROUP BY ALL),
chosen AS (SELECT name, amt, categoria,
    CASE WHEN sum(n_in) OVER (PARTITION BY name, amt) > 0 THEN n_in ELSE n_all END AS n FROM per_cat),
top3 AS (SELECT *, row_number() OVER (PARTITION BY name, amt ORDER BY n DESC, categoria) AS rn FROM chosen WHERE n > 0
  QUALIFY rn <= 3),
scored AS (SELECT *, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY name, amt) AS score FROM top3),
similar_ AS (SELECT name, amt, arg_min(categoria, rn) AS best, arg_min(score, rn) AS score,
    string_agg(categoria || '=' || CAST(CAST(round(score * 10000) AS INTEGER) AS VARCHAR), '|' ORDER BY rn) AS alternativas
  FROM scored GROUP BY name, amt)"""


def _led(sql: str, *more: str) -> str:
    return f"WITH {', '.join((LED, *more))} {sql}"


def _matches(source: str, window: int, tol: float) -> str:
    return f"""
pairs AS (SELECT c.id, g.id AS gid, g.fecha AS gf, abs(g.amt - c.amt) AS gap
  FROM {source} c JOIN {source} g ON c.monto > 0 AND g.monto < 0
    AND g.fecha BETWEEN c.fecha - {window} AND c.fecha AND abs(g.amt - c.amt) <= {tol}),
best AS (SELECT id, arg_min(gid, (gap, -epoch(gf), gid)) AS match_id FROM pairs GROUP BY id)"""


def _first_rule(source: str) -> str:
    return f"""
hit AS (SELECT m.id, arg_min(r.categoria, r.ord) AS categoria
  FROM {source} m JOIN mrules r ON contains(m.dn, r.key) GROUP BY m.id)"""


def _learned(source: str) -> str:
    return f"""
taught AS (SELECT trim(split_part(dn, '*', 1)) AS key, trim(cat) AS cat, fecha, id
  FROM {source} WHERE trim(coalesce(cat, '')) <> '' AND length(dn) > 3),
learned AS (SELECT key, arg_max(cat, (fecha, id)) AS cat, arg_min(fecha, (fecha, id)) AS since,
    arg_min(id, (fecha, id)) AS since_id FROM taught WHERE length(key) >= 3 GROUP BY key)"""


_RULES_AFTER = f"""
SELECT CAST(coalesce(r.ord, {len(MERCHANT_RULES)}) AS BIGINT) AS ord,
  CASE WHEN r.key IS NULL THEN l.since END AS since, CASE WHEN r.key IS NULL THEN l.since_id END AS since_id,
  coalesce(r.key, l.key) AS key, coalesce(l.cat, r.categoria) AS categoria
FROM mrules r FULL JOIN learned l ON l.key = r.key"""

_OWN = " OR ".join(f"contains(dn, '{x.upper()}')" for x in ALIASES)
_WEEKDAYS = "[" + ", ".join(f"'{w}'" for w in WEEKDAY_NAMES) + "]"
_NOT_OCCASIONAL = " AND ".join(f"NOT contains(lower(categoria), '{w}')" for w in OCCASIONAL_WORDS)

_RAW = """
raw AS (
  SELECT *, CAST(o_orderdate AS DATE) AS dia, CAST(o_totalprice AS DECIMAL(18,2)) AS total,
    CASE o_orderkey % 8
      WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y')
      WHEN 2 THEN strftime(o_orderdate, '%d-%m-%Y') WHEN 3 THEN strftime(o_orderdate, '%d.%m.%Y')
      WHEN 4 THEN strftime(o_orderdate, '%d/%m/%y') WHEN 5 THEN strftime(o_orderdate, '%m/%d/%Y')
      WHEN 6 THEN strftime(o_orderdate, '%Y/%m/%d') ELSE strftime(o_orderdate, '%Y-%m-%d') || ' 00:00:00' END AS date_text,
    [ '1', '0', ' Si', 'SÍ', 'no', 'True', 's', '2', 'verdadero'][o_orderkey % 9 + 1] AS flag_text
  FROM orders),
amounts AS (
  SELECT *, CASE o_orderkey % 5
      WHEN 0 THEN CAST(total AS VARCHAR)
      WHEN 1 THEN format('{:,.2f}', o_totalprice)
      WHEN 2 THEN translate(format('{:,.2f}', o_totalprice), ',.', '.,')
      WHEN 3 THEN '$ ' || replace(CAST(total AS VARCHAR), '.', ',')
      ELSE 'CLP ' || CAST(CAST(floor(total) AS BIGINT) AS VARCHAR) END AS amount_text
  FROM raw)"""


def _try(*formats: str) -> str:
    """Try formats in order; a format counts only where its digits fit the text."""
    digits = {"%Y": "[0-9]{4}", "%y": "[0-9]{2}", "%m": "[0-9]{1,2}", "%d": "[0-9]{1,2}"}

    def one(f: str) -> str:
        shape = f
        for mark, pattern in digits.items():
            shape = shape.replace(mark, pattern)
        shape = shape.replace(".", "[.]")
        return (
            f"CASE WHEN regexp_full_match(date_text, '{shape}') THEN "
            f"CAST(try_strptime(date_text, '{f}') AS DATE) END"
        )

    return "coalesce(" + ", ".join(one(f) for f in formats) + ")"


_ISO = "CAST(try_strptime(date_text, '%Y-%m-%d %H:%M:%S') AS DATE)"
# DuckDB reads two-digit years 00 to 68 as 20xx, as the engine does.
_TEXTS = """
texts AS (SELECT 'doc' AS kind, doc_id AS id, text FROM documents
  UNION ALL SELECT 'part', p_partkey, p_name || ' ' || p_type || ' ' || p_brand FROM part)"""
_BLANKS = r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _squeezed(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_BLANKS}', ' ', 'g'))"


_FLAG_TEXTS = """
flagged AS (SELECT o_orderkey, upper(o_orderpriority || ' ' || ['Traspaso a', 'transferencia de', 'abono', 'abonos',
    'Reembolso', 'REVERSA', 'cashback', 'pago tc', 'pago cuenta', 'dividido con', 'compartida', 'amigos', 'amigosos',
    'sub-traspaso', 'cena con amigos'][o_orderkey % 15 + 1]) AS t FROM orders)"""

_STATEMENTS = f"""
st AS (
  SELECT o_orderkey, c_custkey AS cust, c_custkey % 5 AS kind, 'cliente-' || c_custkey AS source_file,
    CAST(o_orderdate AS DATE) AS fecha,
    c_mktsegment || '*' || c_name || CASE o_orderkey % 7 WHEN 0 THEN ' Transferencia' WHEN 1 THEN ' gasto compartido' ELSE '' END
      || CASE WHEN c_custkey % 5 = 3 THEN '|sucursal' ELSE '' END AS detalle,
    CASE WHEN c_custkey % 5 = 3 OR o_orderstatus = 'P' THEN o_totalprice ELSE -o_totalprice END AS monto
  FROM orders JOIN customer ON o_custkey = c_custkey),
std AS (SELECT *, upper(detalle) AS dn, o_orderkey % 7 = 0 AS transfer, o_orderkey % 7 = 1 AS shared FROM st)"""

_MATRIX = """
matrix AS (SELECT categoria, mes, sum(amt) AS total_mes FROM led WHERE categoria IS NOT NULL GROUP BY ALL)"""
_STATS = """
lastk AS (SELECT DISTINCT mes FROM matrix ORDER BY mes DESC LIMIT 3),
stats AS (SELECT categoria, count(*) AS num_meses, CAST(sum(total_mes) AS DOUBLE) / count(*) AS media,
    stddev_samp(CAST(total_mes AS DOUBLE)) AS sd,
    count(*) FILTER (WHERE mes IN (SELECT mes FROM lastk)) = (SELECT count(*) FROM lastk) AS reciente
  FROM matrix GROUP BY categoria),
stats2 AS (SELECT *, CASE WHEN media > 0 THEN sd / media ELSE CAST('inf' AS DOUBLE) END AS cv FROM stats),
stable AS (SELECT * FROM stats2 WHERE num_meses >= 2 AND (reciente OR (media >= 3000 AND cv <= 1.0)) AND """ + _NOT_OCCASIONAL + ")"
_PROJECTION = f"""
cur AS (SELECT categoria, CAST(sum(amt) AS DOUBLE) AS actual FROM led WHERE mes = '{MONTH}' GROUP BY categoria),
proj AS (SELECT s.categoria, round(s.media, 4) AS prom_mensual, coalesce(c.actual, 0) AS actual_mes,
    round(greatest(s.media - coalesce(c.actual, 0), 0), 4) AS restante_estimado
  FROM stable s LEFT JOIN cur c ON c.categoria = s.categoria)"""

_EDITABLE = """
edit AS (SELECT fecha, detalle, CASE WHEN monto_real > 0 THEN abs(monto_real) ELSE abs(monto) END AS monto,
    CASE WHEN categoria IN (SELECT nombre FROM cats) THEN categoria ELSE 'Sin categoría' END AS categoria,
    coalesce(nota_usuario, '') AS nota_usuario, unique_key FROM led)"""
_CREDIT_KEYS = "(SELECT unique_key FROM led WHERE monto > 0)"
_GONE = """
gone AS (SELECT unique_key FROM led WHERE monto > 0 OR prioridad = '1-URGENT')"""


def _sum(where: str = "") -> str:
    return f"CAST(sum(amt) AS DOUBLE) AS total {where}"


def oracle_sql() -> dict[str, str]:
    """DuckDB text for each named query."""
    sql: dict[str, str] = {}

    # Sources, sinks, snapshots.
    sql["read_statements"] = f"""
      SELECT 'cliente-' || c_custkey AS source_file,
        CASE WHEN c_custkey % 4 = 2 THEN CAST(o_orderkey AS VARCHAR) ELSE CAST(o_orderkey + 1 AS VARCHAR) END AS id,
        CAST(o_orderdate AS DATE) AS fecha, c_mktsegment || '*' || c_name AS detalle,
        CASE WHEN c_custkey % 4 = 3 THEN -o_totalprice ELSE o_totalprice END AS monto,
        CAST(NULL AS VARCHAR) AS es_compartido_posible, CAST(NULL AS DOUBLE) AS fraccion_mia_sugerida,
        CAST(NULL AS DOUBLE) AS monto_mio_estimado, CAST(NULL AS VARCHAR) AS categoria_sugerida,
        {_alnum("c_mktsegment || '*' || c_name")} AS detalle_norm,
        CASE WHEN c_custkey % 4 = 1 THEN o_totalprice END AS monto_real,
        CASE WHEN c_custkey % 4 = 0 THEN o_orderpriority END AS categoria,
        CASE WHEN c_custkey % 4 = 3 THEN o_orderpriority END AS nota_usuario
      FROM orders JOIN customer ON o_custkey = c_custkey"""
    sql["read_statement_files"] = _led(
        f"SELECT fecha, detalle, monto, {_alnum('detalle')} AS detalle_norm FROM led"
    )
    sql["read_statement_files_split"] = """
      SELECT CAST(o_orderkey % 3 AS INTEGER) AS archivo,
        CAST(count(*) OVER w + coalesce(count(*) FILTER (WHERE o_orderkey % 10 = 0) OVER b, 0) AS VARCHAR) AS id,
        CAST(o_orderdate AS DATE) AS fecha,
        CASE o_orderkey % 4 WHEN 0 THEN 'uno "' || o_orderkey || '";' || chr(10) || 'dos' || chr(10) || chr(10) || '; tres'
          WHEN 1 THEN 'tubo 5" ' || o_orderkey WHEN 2 THEN 'todo; ' || o_orderkey ELSE 'simple ' || o_orderkey END AS detalle,
        o_totalprice AS monto
      FROM orders
      WINDOW w AS (PARTITION BY o_orderkey % 3 ORDER BY o_orderkey),
        b AS (PARTITION BY o_orderkey % 3 ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
    sql["rejected_rows"] = """
      SELECT DISTINCT 'cliente-' || o_custkey AS source_file, CAST(NULL AS BIGINT) AS line_no,
        'missing: monto' AS reason, CAST(NULL AS VARCHAR) AS line
      FROM orders WHERE o_custkey % 5 = 1
      UNION ALL
      SELECT 'cliente-' || o_custkey, CAST(o_orderkey AS BIGINT),
        CASE o_orderpriority WHEN '1-URGENT' THEN 'too many cells' ELSE 'amount too large' END,
        '2024-01-02,' || o_orderpriority || ',' ||
          CASE o_orderpriority WHEN '1-URGENT' THEN o_orderkey || ',sobra' ELSE '99999999999999999999' END
      FROM orders
      WHERE o_custkey % 5 <> 1 AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderkey > 0"""
    sql["decode_files"] = (
        "SELECT doc_id, md5(text) AS huella, CAST(length(text) AS INTEGER) AS largo FROM documents"
    )
    counts = ", ".join(
        f"(sum(length(line) - length(replace(line, '{d}', ''))) FILTER (WHERE n <= 40), {-i}, '{d}')"
        for i, d in enumerate(("; , \t |").split(" "))
    )
    sql["sniff_delimiter"] = f"""
      WITH lines AS (SELECT CAST(doc_id AS VARCHAR) AS source_file, unnest(string_split(text, chr(10))) AS line,
          generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)
      SELECT source_file, list_reverse_sort([{counts}])[1][3] AS delim FROM lines GROUP BY source_file"""
    sql["find_header"] = """
      SELECT 'cliente-' || c_custkey AS source_file,
        CASE WHEN c_custkey % 5 = 4 THEN 0 ELSE c_custkey % 4 END AS header_line FROM customer"""
    sql["column_roles"] = r"""
      SELECT 'cliente-' || c_custkey AS source_file, [';', ',', chr(9), '|', ';'][c_custkey % 5 + 1] AS delim,
        CASE WHEN c_custkey % 5 = 4 AND c_custkey NOT IN (SELECT o_custkey FROM orders) THEN 0 ELSE 1 END AS fecha,
        CASE WHEN c_custkey % 5 = 4 AND c_custkey NOT IN (SELECT o_custkey FROM orders) THEN 0 ELSE 2 END AS detalle,
        CASE WHEN c_custkey % 5 = 1 THEN 4 ELSE 0 END AS abono,
        CASE WHEN c_custkey % 5 = 1 THEN 3 ELSE 0 END AS cargo,
        CASE WHEN c_custkey % 5 = 1 THEN 0 ELSE 3 END AS monto FROM customer"""
    sql["standardize"] = f"""
      WITH {_STATEMENTS} SELECT source_file,
        sha1(strftime(fecha, '%Y-%m-%d') || '|' || dn || '|' || CAST(CAST(monto AS DECIMAL(18,2)) AS VARCHAR))[1:16] AS id,
        fecha, detalle, monto, transfer AS es_transferencia_o_abono, shared AS es_compartido_posible,
        CAST(NULL AS VARCHAR) AS categoria, CASE WHEN shared THEN 0.5 ELSE 1.0 END::DOUBLE AS fraccion_mia,
        CASE WHEN monto < 0 THEN monto * CASE WHEN shared THEN 0.5 ELSE 1.0 END::DOUBLE ELSE 0 END AS monto_mio,
        dn AS detalle_norm FROM std"""
    sql["export_standardized"] = f"""
      WITH {MASTER} SELECT
        sha1(strftime(fecha, '%Y-%m-%d') || '|' || dn || '|' || CAST(CAST(monto AS DECIMAL(18,2)) AS VARCHAR))[1:16] AS id,
        fecha, detalle, monto, false AS es_transferencia_o_abono, false AS es_compartido_posible,
        CAST(NULL AS VARCHAR) AS categoria, CAST(1.0 AS DOUBLE) AS fraccion_mia,
        CASE WHEN monto < 0 THEN monto ELSE 0 END AS monto_mio, dn AS detalle_norm FROM mast"""
    sql["store_snapshot"] = _led(f"SELECT {COLS} FROM led")
    sql["export_backup"] = _led(f"SELECT {COLS} FROM led ORDER BY fecha, unique_key")
    sql["export_enriched"] = _led("SELECT * FROM edit", CATS, _EDITABLE)
    sql["ledger_profile"] = _led(
        f"""SELECT (SELECT count(*) FROM led) AS n_movimientos,
          (SELECT count(*) FROM led WHERE estado = 'O' AND prioridad = '3-MEDIUM') AS n_ignorados,
          '{COLS.replace(" ", "")}' AS columnas, unique_key, fecha, detalle, monto
          FROM led ORDER BY fecha DESC, unique_key LIMIT 5"""
    )

    # Row-wise cleaning.
    sql["norm_db"] = (
        f"WITH {_TEXTS} SELECT kind, id, {_squeezed('strip_accents(lower(text))')} AS norm FROM texts"
    )
    sql["norm_cli"] = (
        f"WITH {_TEXTS} SELECT kind, id, upper(replace({_squeezed('strip_accents(text)')}, 'ß', 'SS')) AS norm FROM texts"
    )
    plain = "strip_accents(translate(text, 'ºª', 'oa'))"
    sql["norm_alnum"] = (
        f"WITH {_TEXTS} SELECT kind, id, "
        rf"upper(replace(trim(regexp_replace({plain}, '[^\p{{L}}\p{{N}}]+', ' ', 'g')), 'ß', 'SS')) AS norm FROM texts"
    )
    sql["amount_cli"] = f"""
      WITH {_RAW}, kept AS (SELECT o_orderkey, regexp_replace(amount_text, '[^0-9,.-]', '', 'g') AS k FROM amounts)
      SELECT o_orderkey, TRY_CAST(CASE WHEN contains(k, ',') AND contains(k, '.') THEN replace(replace(k, '.', ''), ',', '.')
        WHEN length(k) - length(replace(k, ',', '')) > 1 THEN replace(k, ',', '') ELSE replace(k, ',', '.') END AS DOUBLE) AS monto FROM kept"""
    sql["amount_app"] = f"""
      WITH {_RAW}, kept AS (SELECT o_orderkey, replace(replace(replace(amount_text, '$', ''), 'CLP', ''), ' ', '') AS k FROM amounts)
      SELECT o_orderkey, TRY_CAST(CASE WHEN contains(k, ',') AND NOT contains(k, '.') THEN replace(k, ',', '.')
        ELSE replace(k, ',', '') END AS DOUBLE) AS monto FROM kept"""
    sql["amount_sep"] = f"""
      WITH {_RAW}, kept AS (SELECT o_orderkey, regexp_replace(amount_text, '[^0-9,.-]', '', 'g') AS k FROM amounts)
      SELECT o_orderkey, TRY_CAST(replace(replace(k, '.', ''), ',', '.') AS DOUBLE) AS monto FROM kept"""
    sql["date_cli"] = f"""WITH {_RAW} SELECT o_orderkey, coalesce({_try('%d-%m-%Y', '%d/%m/%Y', '%Y-%m-%d', '%d-%m-%y',
      '%d/%m/%y', '%m/%d/%Y', '%d.%m.%Y', '%Y/%m/%d', '%Y/%d/%m')}, {_ISO}) AS fecha FROM raw"""
    sql["date_app"] = f"""WITH {_RAW} SELECT o_orderkey, coalesce({_try('%Y-%m-%d', '%Y/%m/%d', '%d-%m-%Y', '%d/%m/%Y',
      '%d.%m.%Y', '%m/%d/%Y', '%Y-%d-%m', '%Y/%d/%m', '%d/%m/%y')}, {_ISO}) AS fecha FROM raw"""
    sql["date_app_ydm"] = f"""WITH {_RAW} SELECT o_orderkey, coalesce({_try('%Y-%d-%m', '%Y/%d/%m', '%Y-%m-%d', '%Y/%m/%d',
      '%d-%m-%Y', '%d/%m/%Y', '%d.%m.%Y', '%m/%d/%Y', '%d/%m/%y')}, {_ISO}) AS fecha FROM raw"""
    sql["flags_truthy"] = f"""WITH {_RAW} SELECT o_orderkey,
      lower(trim(flag_text)) IN ('1', 'true', 't', 'yes', 'y', 'si', 'sí') AS subida,
      lower(trim(flag_text)) IN ('1', '2', 'true', 't', 'yes', 'y', 'si', 'sí', 's', 'verdadero') AS guardada FROM raw"""
    sql["signed_amount"] = f"""
      WITH {_RAW}, kept AS (SELECT *, regexp_replace(amount_text, '[^0-9,.-]', '', 'g') AS k FROM amounts),
      num AS (SELECT *, TRY_CAST(CASE WHEN contains(k, ',') AND contains(k, '.') THEN replace(replace(k, '.', ''), ',', '.')
        WHEN length(k) - length(replace(k, ',', '')) > 1 THEN replace(k, ',', '') ELSE replace(k, ',', '.') END AS DOUBLE) AS m FROM kept)
      SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN m WHEN o_orderstatus = 'P' THEN m
        WHEN o_orderstatus = 'F' THEN -m ELSE 0 END AS monto FROM num"""
    sql["flag_transfer"] = f"""WITH {_FLAG_TEXTS} SELECT o_orderkey, regexp_matches(t,
      '\\bTRASPAS|\\bTRANSFER|\\bABONO\\b|\\bREEMB|\\bREVERSA|\\bCASHBACK|\\bPAGO T|\\bPAGO TARJ') AS transferencia FROM flagged"""
    sql["flag_shared"] = f"""WITH {_FLAG_TEXTS} SELECT o_orderkey,
      regexp_matches(t, '\\bDIVIDID|\\bCOMPARTID|\\bAMIGOS\\b') AS compartido FROM flagged"""
    sql["my_share"] = _led(
        """SELECT id, CASE WHEN es_compartido_posible THEN 0.5 ELSE 1.0 END::DOUBLE AS fraccion_mia,
          CASE WHEN monto < 0 THEN monto * CASE WHEN es_compartido_posible THEN 0.5 ELSE 1.0 END::DOUBLE ELSE 0 END AS monto_mio FROM led"""
    )
    sql["cli_id"] = f"""WITH {MASTER} SELECT id AS orden,
      sha1(strftime(fecha, '%Y-%m-%d') || '|' || dn || '|' || CAST(CAST(monto AS DECIMAL(18,2)) AS VARCHAR))[1:16] AS id FROM mast"""
    sql["ledger_key"] = f"""WITH {MOV} SELECT id, lower(detalle) AS detalle_norm, abs(monto) AS monto_cartola,
      {_key('fecha', 'lower(detalle)', 'monto')} AS unique_key FROM mov"""
    sql["manual_key"] = f"""WITH {MOV} SELECT id, 'm:' || sha1(strftime(fecha, '%Y-%m-%d') || '|' ||
      CAST({_amt('monto')} AS VARCHAR) || '|' || {_alnum('detalle')})[1:16] AS unique_key FROM mov"""
    sql["force_expense"] = f"""WITH {MOV} SELECT id, -abs(monto) AS monto, abs(monto) AS monto_cartola, 'Gasto' AS tipo,
      true AS es_gasto, false AS es_transferencia_o_abono, es_compartido_posible FROM mov"""
    sql["default_real"] = _led(
        """SELECT id, coalesce(nullif(monto_real, 0), CASE WHEN es_compartido_posible THEN abs(monto_mio_estimado) END,
          CASE WHEN monto < 0 THEN abs(monto) ELSE 0 END) AS monto_real FROM led"""
    )
    sql["row_type"] = _led(
        """SELECT id, 'gasto' AS base, CASE WHEN es_gasto THEN 'Gasto' ELSE 'Abono' END AS tipo FROM led
          UNION ALL SELECT id, 'transferencia', CASE WHEN es_transferencia_o_abono THEN 'Abono' ELSE 'Gasto' END FROM led
          UNION ALL SELECT id, 'signo', CASE WHEN monto < 0 THEN 'Gasto' WHEN monto > 0 THEN 'Abono' ELSE 'Cero' END FROM led
          UNION ALL SELECT id, 'positivos', 'Gasto' FROM led"""
    )
    sql["effective_amount"] = _led(
        "SELECT id, CASE WHEN monto_real > 0 THEN monto_real ELSE abs(monto) END AS monto FROM led"
    )
    sql["category_reset"] = _led(
        """SELECT id, CASE WHEN categoria IN (SELECT nombre FROM cats) THEN categoria ELSE 'Sin categoría' END AS categoria FROM led""",
        CATS,
    )
    sql["ignored_parsed"] = _led(
        "SELECT unique_key, detalle AS nombre, CASE WHEN coalesce(monto_real, 0) = 0 THEN monto ELSE monto_real END AS monto FROM ign",
        STORED,
    )

    # Ingest and table changes.
    sql["ingest"] = f"""WITH {INGEST} SELECT id, fecha, detalle, -abs(monto) AS monto, true AS es_gasto,
      false AS es_transferencia_o_abono, es_compartido_posible, CAST(NULL AS DOUBLE) AS fraccion_mia_sugerida,
      monto_mio_estimado, CAST(NULL AS VARCHAR) AS categoria_sugerida, detalle_norm, abs(monto_mio_estimado) AS monto_real,
      cat AS categoria, nota AS nota_usuario, unique_key FROM alive WHERE nth = 1 AND NOT held"""
    sql["ingest_ignored"] = f"""WITH {INGEST} SELECT unique_key, detalle, nota AS nota_usuario, cat AS categoria
      FROM alive WHERE nth = CASE WHEN held THEN 1 ELSE 2 END"""
    sql["ingest_counts"] = f"""WITH {INGEST} SELECT
      (SELECT count(*) FROM alive WHERE nth = 1 AND NOT held) AS insertadas,
      (SELECT count(*) FROM alive WHERE nth > 1 OR held) AS duplicadas,
      (SELECT count(*) FROM batch WHERE unique_key IN (SELECT unique_key FROM deleted)) AS borradas,
      (SELECT count(*) FROM batch WHERE unique_key NOT IN (SELECT unique_key FROM deleted)
        AND unique_key IN (SELECT unique_key FROM ign)) AS ignoradas"""
    sql["tombstone_filter"] = _led(
        "SELECT unique_key, line_no FROM batch WHERE unique_key NOT IN (SELECT unique_key FROM deleted)", STORED
    )
    sql["ignored_filter"] = _led(
        "SELECT unique_key, line_no FROM batch WHERE unique_key NOT IN (SELECT unique_key FROM ign)", STORED
    )
    sql["ignored_filter_empty_ledger"] = _led("SELECT unique_key, line_no FROM batch", STORED)
    sql["upsert_inserted"] = f"""WITH {UPSERT} SELECT unique_key, fecha, detalle, -abs(monto) AS monto,
      nota AS nota_usuario, categoria FROM alive WHERE nth = 1 AND NOT held"""
    sql["upsert_ignored"] = f"""WITH {UPSERT} SELECT unique_key, detalle, nota AS nota_usuario, categoria
      FROM alive WHERE nth = CASE WHEN held THEN 1 ELSE 2 END"""
    sql["dedup_latest"] = _led(
        f"""SELECT {COLS} FROM (SELECT {COLS} FROM led WHERE NOT coalesce(monto_real > 0, false)
          UNION ALL SELECT {COLS.replace('fecha,', 'CAST(fecha + 7 AS DATE) AS fecha,').replace('nota_usuario,', "'movida' AS nota_usuario,")}
          FROM led WHERE monto_real > 0)"""
    )
    sql["master_merge"] = f"""WITH {MASTER} SELECT id, fecha, monto,
      CASE WHEN estado <> 'O' THEN 'vieja' ELSE cat END AS categoria FROM mast"""
    sql["apply_edits"] = _led(
        """SELECT id, unique_key, CASE WHEN monto > 0 THEN NULL WHEN estado = 'O' THEN 'Ocio' ELSE categoria END AS categoria,
          CASE WHEN monto > 0 THEN monto / 2 WHEN estado = 'O' THEN NULL ELSE monto_real END AS monto_real,
          CASE WHEN monto > 0 THEN 'dos' WHEN estado = 'O' THEN NULL ELSE nota_usuario END AS nota_usuario FROM led"""
    )
    sql["delete_rows"] = _led(
        "SELECT id, unique_key FROM led WHERE unique_key NOT IN (SELECT unique_key FROM gone)", _GONE
    )
    sql["ignored_after_delete"] = _led(
        """SELECT unique_key, unique_key NOT IN (SELECT unique_key FROM ign) AS sin_datos
          FROM (SELECT unique_key FROM ign UNION SELECT unique_key FROM gone)""",
        STORED,
        _GONE,
    )
    sql["tombstones_after"] = _led(
        "SELECT unique_key FROM deleted UNION SELECT unique_key FROM gone", STORED, _GONE
    )
    sql["count_deleted"] = _led("SELECT count(*) AS borradas FROM gone", _GONE)
    sql["save_diff"] = _led(
        """SELECT e.unique_key, e.categoria, e.monto AS monto_real, 'editada' AS nota_usuario
          FROM edit e JOIN led l ON l.unique_key = e.unique_key WHERE l.monto <= 0""",
        CATS,
        _EDITABLE,
    )
    manual = f"""'m:' || sha1(strftime(fecha, '%Y-%m-%d') || '|' || CAST(amt AS VARCHAR) || '|' || {_alnum('detalle')})[1:16]"""
    sql["manual_append"] = _led(
        f"""SELECT unique_key, fecha, detalle, detalle_norm, monto, monto_real, categoria, nota_usuario FROM led
          UNION ALL SELECT {manual}, fecha, detalle, {_alnum('detalle')}, abs(monto), abs(monto),
            coalesce(nullif(categoria, ''), 'Sin categoría'), coalesce(nota_usuario, '')
          FROM led WHERE prioridad NOT IN ('5-LOW', '3-MEDIUM')"""
    )
    kept = COLS.replace("nota_usuario,", "'actual' AS nota_usuario,")
    back = "(SELECT unique_key FROM ign)"
    sql["restore_ignored"] = _led(
        f"""SELECT {kept} FROM led WHERE monto < 0 AND unique_key NOT IN {back}
          UNION ALL SELECT {COLS} FROM led WHERE unique_key IN {back}""",
        STORED,
    )
    sql["ignored_after_restore"] = _led("SELECT unique_key FROM deleted", STORED)
    off = "monto_real > 0 AND (monto IS NULL OR monto = 0 OR abs(monto) <> monto_real)"
    sql["repair_amounts"] = _led(
        f"SELECT id, CASE WHEN {off} THEN monto_real ELSE monto END AS monto, monto_real FROM led"
    )
    sql["repair_count"] = _led(f"SELECT count(*) AS reparados FROM led WHERE {off}")
    sql["job_edit"] = sql["apply_edits"]
    sql["job_delete_reimport"] = _led(
        """SELECT unique_key, fecha, -abs(any_value(monto)) AS monto FROM led
          WHERE NOT (estado <> 'O' AND prioridad = '1-URGENT') GROUP BY unique_key, fecha"""
    )
    sql["job_save"] = sql["save_diff"]
    sql["job_manual"] = sql["manual_append"]
    sql["job_restore"] = sql["restore_ignored"]
    sql["job_repair"] = sql["repair_amounts"]
    sql["job_rename"] = _led(
        """SELECT id, CASE WHEN categoria = 'Cat3' THEN 'Cat4' ELSE categoria END AS categoria FROM led
          UNION ALL SELECT NULL, nombre FROM cats WHERE nombre <> 'Cat3'""",
        CATS,
    )
    sql["master_roundtrip"] = f"""WITH {MASTER} SELECT id, fecha, detalle, monto, cat AS categoria,
      fraccion_mia_sugerida AS fraccion_mia, monto_mio_estimado AS monto_mio, dn AS detalle_norm FROM mast"""
    sql["read_rules"] = """SELECT row_number() OVER (ORDER BY p_brand) - 1 AS ord, p_brand AS key,
      'Marca ' || p_brand AS categoria FROM (SELECT DISTINCT p_brand FROM part)"""
    sql["draft_overlay"] = _led(
        """SELECT unique_key, CASE WHEN monto > 0 THEN monto * 2 ELSE monto END AS monto,
          CASE WHEN monto > 0 THEN CASE WHEN monto_real > 0 THEN 'Borrador' END ELSE categoria END AS categoria,
          CASE WHEN monto > 0 THEN 'borrador' ELSE nota_usuario END AS nota_usuario FROM led"""
    )
    sql["draft_restrict"] = _led(
        """SELECT fecha, detalle, monto * 2 AS monto, CASE WHEN monto_real > 0 THEN 'Borrador' END AS categoria,
          'borrador' AS nota_usuario, unique_key FROM led WHERE monto > 0"""
    )
    sql["ingest_stream_ledger"] = _led(
        """SELECT unique_key, any_value(fecha) AS fecha, any_value(detalle) AS detalle, -any_value(abs(monto)) AS monto,
          true AS es_gasto, 'Sin categoría' AS categoria FROM led GROUP BY unique_key"""
    )

    # Categorisation.
    fresh = """
new_ AS (SELECT * FROM mast WHERE estado = 'O'),
old_ AS (SELECT * FROM mast WHERE estado <> 'O')"""
    merged = f"""
full_ AS (SELECT * EXCLUDE (cat), cat, false AS own FROM old_ UNION ALL
  SELECT n.* EXCLUDE (cat), coalesce(n.cat, h.categoria) AS cat, {_OWN} AS own FROM new_ n LEFT JOIN hit h ON h.id = n.id)"""
    sql["update_master"] = f"""
      WITH {MASTER}, {MRULES}, {fresh}, {_first_rule('new_')}, {merged}, {_matches('full_', 21, 1000)}
      SELECT f.id, f.cat AS categoria, f.own AS es_entre_cuentas, b.match_id,
        f.monto < 0 AND NOT f.es_transferencia_o_abono AS es_gasto,
        CASE WHEN f.monto < 0 AND NOT f.es_transferencia_o_abono AND NOT f.own THEN f.monto * f.fraccion_mia_sugerida ELSE 0 END AS monto_mio
      FROM full_ f LEFT JOIN best b ON b.id = f.id"""
    sql["run_update_master"] = f"""
      WITH {MASTER}, {MRULES}, {_first_rule('mast')},
      old1 AS (SELECT m.* EXCLUDE (cat), coalesce(m.cat, h.categoria) AS cat FROM mast m LEFT JOIN hit h ON h.id = m.id
        WHERE m.estado <> 'O'), {_learned('old1')},
      rules2 AS ({_RULES_AFTER}),
      hit2 AS (SELECT m.id, arg_min(r.categoria, (r.ord, r.since, r.since_id)) AS categoria
        FROM mast m JOIN rules2 r ON contains(m.dn, r.key) GROUP BY m.id),
      both_ AS (SELECT * EXCLUDE (cat), cat FROM old1 UNION ALL
        SELECT m.* EXCLUDE (cat), coalesce(m.cat, h.categoria) AS cat FROM mast m LEFT JOIN hit2 h ON h.id = m.id
        WHERE m.estado = 'O'),
      full_ AS (SELECT *, {_OWN} AS own FROM both_), {_matches('full_', 21, 1000)}
      SELECT f.id, f.cat AS categoria, f.own AS es_entre_cuentas, b.match_id,
        f.monto < 0 AND NOT f.es_transferencia_o_abono AS es_gasto,
        CASE WHEN f.monto < 0 AND NOT f.es_transferencia_o_abono AND NOT f.own THEN f.monto * f.fraccion_mia_sugerida ELSE 0 END AS monto_mio
      FROM full_ f LEFT JOIN best b ON b.id = f.id"""
    sql["update_master_rules"] = (
        f"WITH {MASTER}, {MRULES}, {fresh}, {_first_rule('new_')}, {merged}, {_learned('full_')} {_RULES_AFTER}"
    )
    sql["merchant_rules"] = f"""WITH {MASTER}, {MRULES}, {_first_rule('mast')}
      SELECT m.id, coalesce(m.cat, h.categoria) AS categoria FROM mast m LEFT JOIN hit h ON h.id = m.id"""
    sql["merchant_rules_join"] = sql["merchant_rules"]
    sql["own_transfers"] = f"WITH {MASTER} SELECT id, {_OWN} AS es_entre_cuentas FROM mast"
    sql["reimbursements"] = _led(
        "SELECT l.id, b.match_id FROM led l LEFT JOIN best b ON b.id = l.id", _matches("led", 21, 1000)
    )
    sql["reimbursements_events"] = f"""WITH {EVENTS}, {_matches('ev', 3, 1)}
      SELECT e.id, b.match_id FROM ev e LEFT JOIN best b ON b.id = e.id"""
    sql["net_mine"] = f"""WITH {MASTER} SELECT id, es_gasto, fraccion_mia_sugerida AS fraccion_mia,
      CASE WHEN es_gasto AND NOT ({_OWN}) THEN monto * fraccion_mia_sugerida ELSE 0 END AS monto_mio FROM mast"""
    sql["learn_merchant"] = f"WITH {MASTER}, {MRULES}, {_learned('mast')} {_RULES_AFTER}"
    sql["map_categories"] = _led(
        """SELECT l.id, l.detalle_norm, coalesce(nullif(coalesce(CASE WHEN trim(l.categoria) NOT IN ('', 'nan', 'None') THEN l.categoria END,
          r.categoria), ''), 'Sin categoría') AS categoria FROM led l LEFT JOIN xrules r ON r.detalle_norm = l.detalle_norm""",
        XRULES,
    )
    sql["learn_rules"] = _led(
        """SELECT coalesce(r.detalle_norm, t.detalle_norm) AS detalle_norm, coalesce(t.c, r.categoria) AS categoria
          FROM xrules r FULL JOIN (SELECT detalle_norm, arg_min(categoria, orden) AS c FROM led
            WHERE trim(coalesce(categoria, '')) <> '' GROUP BY detalle_norm) t ON t.detalle_norm = r.detalle_norm""",
        XRULES,
    )
    sql["rename_category"] = _led(
        "SELECT id, CASE WHEN categoria = 'Cat3' THEN 'Cat4' ELSE categoria END AS categoria FROM led"
    )
    sql["rename_category_list"] = _led("SELECT nombre FROM cats WHERE nombre <> 'Cat3'", CATS)
    sql["rename_category_rules"] = f"""WITH {XRULES} SELECT detalle_norm,
      CASE WHEN categoria = 'Vivienda' THEN 'Casa' ELSE categoria END AS categoria FROM xrules"""
    sql["pending"] = _led("SELECT unique_key, detalle_norm FROM pend", PEND)
    sql["suggest_exact"] = _led(
        """SELECT p.unique_key, p.detalle, p.detalle_norm, r.categoria AS sugerida, 'Mapa exacto' AS fuente,
          CAST(1.0 AS DOUBLE) AS confianza FROM pend p JOIN xrules r ON r.detalle_norm = p.detalle_norm WHERE trim(r.categoria) <> ''""",
        PEND,
        XRULES,
    )
    sql["suggest_dominant"] = _led(
        """SELECT p.unique_key, p.detalle, p.detalle_norm, d.categoria AS sugerida, 'Historial dominante' AS fuente,
          CAST(0.8 AS DOUBLE) AS confianza FROM pend p JOIN dominant d ON d.detalle_norm = p.detalle_norm""",
        PEND,
        DOMINANT,
    )
    sql["history_base"] = _led(
        """SELECT upper(trim(detalle_norm)) AS name, categoria, CAST(amt * 100 AS BIGINT) AS cents FROM led
          WHERE categoria IS NOT NULL AND categoria <> 'Sin categoría' AND trim(detalle_norm) <> ''"""
    )
    label = "'Nombres similares (' || printf('%.2f', s.score) || ')'"
    sql["suggest_similar"] = _led(
        f"""SELECT p.unique_key, s.best AS sugerida, {label} AS fuente, round(s.score, 8) AS confianza, s.alternativas
          FROM pend p JOIN similar_ s ON s.name = upper(trim(p.detalle_norm)) AND s.amt = p.amt""",
        PEND,
        SIMILAR,
    )
    sql["suggestions"] = _led(
        f"""SELECT p.unique_key, p.detalle, p.detalle_norm,
          coalesce(r.categoria, d.categoria, s.best, 'Sin categoría') AS sugerida,
          CASE WHEN r.categoria IS NOT NULL THEN 'Mapa exacto' WHEN d.categoria IS NOT NULL THEN 'Historial dominante'
            WHEN s.best IS NOT NULL THEN {label} ELSE 'Sin sugerencia' END AS fuente,
          CASE WHEN r.categoria IS NOT NULL THEN CAST(1.0 AS DOUBLE) WHEN d.categoria IS NOT NULL THEN CAST(0.8 AS DOUBLE)
            ELSE round(coalesce(s.score, 0), 8) END AS confianza,
          CASE WHEN r.categoria IS NULL AND d.categoria IS NULL THEN coalesce(s.alternativas, '') ELSE '' END AS alternativas_sim,
          p.monto
        FROM pend p LEFT JOIN (SELECT * FROM xrules WHERE trim(categoria) <> '') r ON r.detalle_norm = p.detalle_norm
          LEFT JOIN dominant d ON d.detalle_norm = p.detalle_norm
          LEFT JOIN similar_ s ON s.name = upper(trim(p.detalle_norm)) AND s.amt = p.amt""",
        PEND,
        XRULES,
        DOMINANT,
        SIMILAR,
    )
    sql["apply_decisions"] = _led(
        """SELECT id, CASE WHEN monto > 0 AND unique_key IN (SELECT unique_key FROM pend) THEN 'Ingresos' ELSE categoria END AS categoria FROM led""",
        PEND,
    )
    sql["job_decisions"] = sql["apply_decisions"]
    sql["apply_decisions_rules"] = _led(
        """SELECT coalesce(r.detalle_norm, t.detalle_norm) AS detalle_norm, coalesce(t.c, r.categoria) AS categoria
          FROM xrules r FULL JOIN (SELECT DISTINCT detalle_norm, 'Ingresos' AS c FROM pend WHERE monto > 0) t
            ON t.detalle_norm = r.detalle_norm""",
        PEND,
        XRULES,
    )

    # Filters and views.
    sql["filter_text"] = _led(
        "SELECT id FROM led WHERE regexp_matches(detalle_norm, '(?i)HOLD customer|new [0-9]*5')"
    )
    sql["filter_range"] = _led("SELECT id FROM led WHERE fecha BETWEEN '1996-02-10' AND '1999-11-20'")
    sql["filter_day"] = _led("SELECT id FROM led WHERE fecha = '1998-03-05'")
    sql["filter_month"] = _led(f"SELECT id FROM led WHERE mes = '{MONTH}'")
    sql["filter_category"] = _led("SELECT id FROM led WHERE categoria IN ('Cat1', 'Cat2', '')")
    base = "contains(detalle_norm, 'customer') AND categoria IN ('Cat1', 'Cat2', 'Cat3')"
    span = "fecha BETWEEN '1997-01-01' AND '1999-12-31'"
    sql["scopes"] = _led(
        f"""SELECT 'comparacion' AS alcance, id, monto FROM led WHERE {base}
          UNION ALL SELECT 'analisis', id, monto FROM led WHERE {base} AND {span}
          UNION ALL SELECT 'vista', id, monto FROM led WHERE {base} AND {span} AND mes = '{MONTH}'"""
    )
    sql["months"] = _led("SELECT DISTINCT mes FROM led")
    sql["date_bounds"] = _led("SELECT min(fecha) AS min_fecha, max(fecha) AS max_fecha FROM led")
    sql["current_month"] = _led("SELECT id, fecha FROM led WHERE mes = (SELECT max(mes) FROM led)")
    sql["table_sort"] = _led("SELECT * FROM edit ORDER BY monto DESC, unique_key", CATS, _EDITABLE)
    sql["table_summary"] = _led(
        """SELECT count(*) AS transacciones, CAST(sum(amt) AS DOUBLE) AS total,
          round(CAST(sum(amt) AS DOUBLE) / count(*), 4) AS promedio FROM led"""
    )
    sql["editable_view"] = _led("SELECT * FROM edit", CATS, _EDITABLE)

    # Aggregates.
    sql["total_spend"] = _led(f"SELECT {_sum()} FROM led")
    days = "date_diff('day', min(fecha), max(fecha)) + 1"
    sql["daily_mean"] = _led(
        f"SELECT CAST({days} AS INTEGER) AS dias, round(CAST(sum(amt) AS DOUBLE) / ({days}), 4) AS promedio_diario FROM led"
    )
    per_month = "per_month AS (SELECT mes, sum(amt) AS total FROM {} GROUP BY mes)"
    sql["monthly_mean"] = _led(
        "SELECT round(CAST(sum(total) AS DOUBLE) / count(*), 4) AS promedio_mensual FROM per_month",
        per_month.format("led"),
    )
    change = """
      chg AS (SELECT mes, CAST(total AS DOUBLE) AS actual, CAST(lag(total) OVER (ORDER BY mes) AS DOUBLE) AS anterior FROM per_month
        QUALIFY mes = max(mes) OVER ()),
      pct AS (SELECT *, CASE WHEN anterior > 0 THEN (actual - anterior) / anterior * 100 END AS p FROM chg)
      SELECT mes, actual, anterior, round(p, 6) AS pct, CASE WHEN anterior IS NULL THEN 'n/a'
        WHEN anterior <= 0 THEN 'nuevo mes sin base' ELSE printf('%+.1f', p) || '% vs mes anterior' END AS texto FROM pct"""
    sql["mom_change"] = f"WITH {LED}, {per_month.format('led')}, {change}"
    sql["mom_change_one_month"] = f"WITH {EVENTS}, {per_month.format('ev')}, {change}"
    top = "SELECT {0}, {1} FROM {2} {3} GROUP BY {0} ORDER BY total DESC, {0} LIMIT {4}"
    sql["top_place"] = _led(
        top.format("detalle_norm", _sum(), "led", "WHERE mes = (SELECT max(mes) FROM led)", 1)
    )
    sql["top_category"] = _led(
        top.format("categoria", _sum(), "led", "WHERE categoria IS NOT NULL", 1)
    )
    sql["spend_by_category"] = _led(
        """SELECT categoria, CAST(sum(amt) AS DOUBLE) AS total, CAST(sum(sum(amt)) OVER () AS DOUBLE) AS total_general,
          round(CAST(sum(amt) AS DOUBLE) / CAST(sum(sum(amt)) OVER () AS DOUBLE), 8) AS proporcion FROM led GROUP BY categoria"""
    )
    sql["top5_places"] = _led(
        top.format("detalle_norm", _sum(), "led", f"WHERE mes = '{MONTH}'", 5)
    )
    sql["top5_places_items"] = f"WITH {ITEMS} " + top.format(
        "detalle_norm", _sum(), "li", "WHERE mes = (SELECT max(mes) FROM li)", 5
    )
    freq = "SELECT categoria, count(*) AS veces FROM led WHERE categoria IS NOT NULL GROUP BY categoria"
    sql["freq_by_category"] = _led(freq)
    sql["freq_by_category_top"] = _led(f"{freq} ORDER BY veces DESC, categoria LIMIT 12")
    sql["spend_by_weekday"] = _led(
        f"""SELECT {_WEEKDAYS}[isodow(fecha)] AS dow, CAST(isodow(fecha) - 1 AS INTEGER) AS dow_idx, {_sum()}
          FROM led GROUP BY isodow(fecha)"""
    )
    ticket = """SELECT categoria, round(CAST(sum(amt) AS DOUBLE) / count(*), 4) AS ticket_prom FROM led
      WHERE categoria IS NOT NULL GROUP BY categoria"""
    sql["ticket_by_category"] = _led(ticket)
    sql["ticket_by_category_top"] = _led(f"{ticket} ORDER BY ticket_prom DESC, categoria LIMIT 12")
    before = f"strftime(CAST('{MONTH}-01' AS DATE) - INTERVAL 1 MONTH, '%Y-%m')"
    compared = f"""
      cmp AS (SELECT categoria, CASE WHEN mes = '{MONTH}' THEN 'Actual' ELSE 'Anterior' END AS mes, {_sum()}
        FROM led WHERE categoria IS NOT NULL AND mes IN ('{MONTH}', {before}) GROUP BY ALL)"""
    sql["month_compare"] = _led("SELECT * FROM cmp", compared)
    sql["month_compare_order"] = _led(
        """SELECT categoria, max(total) FILTER (WHERE mes = 'Actual') AS actual,
          CAST(row_number() OVER (ORDER BY max(total) FILTER (WHERE mes = 'Actual') DESC NULLS LAST, sum(total) DESC, categoria) AS INTEGER) AS posicion
          FROM cmp GROUP BY categoria""",
        compared,
    )
    sql["monthly_trend"] = _led("SELECT mes, CAST(sum(amt) AS DOUBLE) AS monto FROM led GROUP BY mes")
    sql["monthly_trend_items"] = (
        f"WITH {ITEMS} SELECT mes, CAST(sum(amt) AS DOUBLE) AS monto FROM li GROUP BY mes"
    )
    sql["month_category"] = _led(
        "SELECT categoria, mes, CAST(total_mes AS DOUBLE) AS total_mes FROM matrix", _MATRIX
    )
    stats = "SELECT categoria, num_meses, round(media, 4) AS prom_mensual, round(sd, 4) AS desv, round(cv, 6) AS cv FROM stats2"
    sql["category_stats"] = _led(stats, _MATRIX, _STATS)
    sql["category_stats_one_month"] = (
        f"WITH {EVENTS}, {_MATRIX.replace('FROM led', 'FROM ev')}, {_STATS} {stats}"
    )
    sql["last_k_presence"] = _led(
        "SELECT categoria, reciente AS presente_ultimos_k FROM stats2", _MATRIX, _STATS
    )
    sql["stable_categories"] = _led(
        """SELECT categoria, num_meses, round(media, 4) AS prom_mensual, round(cv, 6) AS cv,
          reciente AS presente_ultimos_k FROM stable""",
        _MATRIX,
        _STATS,
    )
    sql["projection"] = _led("SELECT * FROM proj", _MATRIX, _STATS, _PROJECTION)
    sql["projection_totals"] = _led(
        """SELECT CAST(sum(CAST(prom_mensual AS DECIMAL(28,4))) AS DOUBLE) AS total_proyectado,
          CAST(sum(CAST(actual_mes AS DECIMAL(28,4))) AS DOUBLE) AS total_actual,
          CAST(sum(CAST(restante_estimado AS DECIMAL(28,4))) AS DOUBLE) AS total_restante FROM proj""",
        _MATRIX,
        _STATS,
        _PROJECTION,
    )
    return sql
