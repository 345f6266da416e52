"""SQL of the address and history queries, built from the same fixed values as the expressions."""

from __future__ import annotations

from ..functions.address import (
    ALWAYS_RESIDENTIAL, BOUND, CITIES, F1_RESIDENTIAL, HIGHWAY_NAMES, LEADING_DIRECTIONS, M1_RESIDENTIAL,
    SPELLINGS, TOKENS, TYPES_TO_STRIP,
)
from ..functions.history import PRIMARY_DATES


def _quote(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def street_sql(x: str) -> str:
    """normalize_street as a DuckDB expression."""
    table = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in TOKENS.items()) + "}"
    clean = f"regexp_replace(upper({x}), '[^A-Z0-9\\s]', ' ', 'g')"
    words = f"list_filter(regexp_split_to_array({clean}, '\\s+'), lambda w: w <> '')"
    mapped = f"list_transform({words}, lambda w: coalesce({table}[w], w))"
    text = f"array_to_string(list_filter({mapped}, lambda w: w NOT IN ({_quote(BOUND)})), ' ')"
    for pattern, new in SPELLINGS:
        text = f"regexp_replace({text}, '{pattern}', '{new}', 'g')"
    return f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"


def _variants(source: str, key: str, street: str, name: str) -> str:
    """CTEs: {name}(key, street, label, variant) of a table with one street per key."""
    words = f"string_split({street}, ' ')"
    no_type = lambda s: f"CASE WHEN len(string_split({s}, ' ')) >= 2 AND list_last(string_split({s}, ' ')) IN ({_quote(TYPES_TO_STRIP)}) THEN array_to_string(string_split({s}, ' ')[:-2], ' ') ELSE '' END"
    no_dir = (
        f"CASE WHEN len({words}) >= 2 AND {words}[1] IN ({_quote(LEADING_DIRECTIONS)}) AND NOT regexp_matches({words}[2], '^[0-9]+$') "
        f"AND {words}[2] NOT IN ({_quote(HIGHWAY_NAMES)}) THEN array_to_string({words}[2:], ' ') ELSE '' END"
    )
    return (
        f"{name}_f AS (SELECT {key}, {street} AS s0, {no_type(street)} AS s1, {no_dir} AS s2 FROM {source}), "
        f"{name}_g AS (SELECT *, {no_type('s2')} AS s3 FROM {name}_f), "
        f"{name}_u AS (SELECT {key}, s0 AS street, '' AS label, 0 AS o FROM {name}_g UNION ALL SELECT {key}, s1, '_no_type', 1 FROM {name}_g "
        f"UNION ALL SELECT {key}, s2, '_no_dir', 2 FROM {name}_g UNION ALL SELECT {key}, s3, '_no_dir_no_type', 3 FROM {name}_g), "
        f"{name} AS (SELECT {key}, street, label, row_number() OVER (PARTITION BY {key} ORDER BY o) - 1 AS variant FROM "
        f"(SELECT * FROM {name}_u WHERE street <> '' QUALIFY row_number() OVER (PARTITION BY {key}, street ORDER BY o) = 1))"
    )


_RAW_V = "concat_ws(' ', pre, name1, type)"
_RAW_P = "concat_ws(' ', prefix, street, suffix)"
STREET_CTE = (
    f"raws AS (SELECT DISTINCT {_RAW_V} AS raw FROM registration UNION SELECT DISTINCT {_RAW_P} FROM properties), "
    f"norm AS (SELECT raw, {street_sql('raw')} AS st FROM raws), " + _variants("norm", "raw", "st", "variants")
)

_UNIT = "trim(regexp_replace(regexp_replace({x}, '[#.,]', ' ', 'g'), '^ *(APT|UNIT) ', ''))"
_LEVEL_KEYS = """SELECT {cols}, 0 AS level_no, 'num_street_unit_zip' || label AS level, number || ' ' || st || ' ' || u || ' ' || zip AS key FROM {t} WHERE u <> '' AND zip <> ''
UNION ALL SELECT {cols}, 1, 'num_street_zip' || label, number || ' ' || st || ' ' || zip FROM {t} WHERE zip <> ''
UNION ALL SELECT {cols}, 2, 'num_street_unit' || label, number || ' ' || st || ' ' || u FROM {t} WHERE u <> ''
UNION ALL SELECT {cols}, 3, 'num_street' || label, number || ' ' || st FROM {t}"""


def _contains(x: str, markers) -> str:
    return "(" + " OR ".join(f"contains({x}, '{m}')" for m in markers) + ")"


_CODES = "list_transform(string_split(state_codes, ';'), lambda c: upper(trim(c)))"
_RESIDENTIAL = (
    f"({_contains('upper(type_desc)', ALWAYS_RESIDENTIAL)} OR len(list_filter({_CODES}, lambda c: substr(c, 1, 1) IN ('A', 'B', 'E', 'O'))) > 0 "
    f"OR (list_contains({_CODES}, 'F1') AND {_contains('upper(type_desc)', F1_RESIDENTIAL)}) "
    f"OR (list_contains({_CODES}, 'M1') AND {_contains('upper(type_desc)', M1_RESIDENTIAL)}))"
)

PROPERTY_CTE = (
    "voter AS (SELECT vuid, number, " + _RAW_V + " AS raw, " + _UNIT.format(x="unit") + " AS u, zip FROM "
    "(SELECT * FROM registration QUALIFY row_number() OVER (PARTITION BY vuid ORDER BY ord) = 1) WHERE NOT contains(city, '***')), "
    f"vnorm AS (SELECT raw, {street_sql('raw')} AS st FROM (SELECT DISTINCT raw FROM voter)), "
    + _variants("vnorm", "raw", "st", "vforms")
    + f", vkeyed AS (SELECT raw, {street_sql('street')} AS st, label, variant FROM vforms), "
    "vall AS (SELECT voter.*, st, label, variant FROM voter JOIN vkeyed USING (raw)), "
    "vkeys AS (" + _LEVEL_KEYS.format(cols="vuid, variant", t="vall") + "), "
    "prop AS (SELECT *, " + _RAW_P + " AS raw, concat_ws(' ', prefix, street) AS raw2, " + _UNIT.format(x="unit") + f" AS u, {_RESIDENTIAL} AS is_residential FROM properties), "
    f"pnorm AS (SELECT raw, {street_sql('raw')} AS st FROM (SELECT DISTINCT raw FROM prop)), "
    + _variants("pnorm", "raw", "st", "pforms")
    + f", pbare AS (SELECT raw, {street_sql('raw2')} AS street FROM (SELECT DISTINCT raw, raw2 FROM prop)), "
    "pboth AS (SELECT raw, street, label FROM pforms UNION ALL SELECT pbare.raw, pbare.street, '' FROM pbare JOIN pnorm USING (raw) WHERE pbare.street <> pnorm.st), "
    f"pkeyed AS (SELECT DISTINCT raw, {street_sql('street')} AS st, label FROM pboth), "
    "pall AS (SELECT prop.prop_id, prop.ord, prop.number, prop.zip, prop.u, prop.is_residential, prop.type_desc, prop.state_codes, st, label FROM prop JOIN pkeyed USING (raw)), "
    "pkeys AS (SELECT * FROM (" + _LEVEL_KEYS.format(cols="prop_id, ord, is_residential, type_desc, state_codes", t="pall") + ") "
    "QUALIFY row_number() OVER (PARTITION BY level_no, key ORDER BY is_residential DESC, ord) = 1), "
    "hits AS (SELECT v.vuid, v.level, v.variant * 4 + v.level_no AS rank, p.prop_id, p.is_residential, p.type_desc, p.state_codes FROM vkeys v JOIN pkeys p USING (level_no, key)), "
    "best AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY vuid ORDER BY rank) = 1), "
    "matched AS (SELECT voter.vuid, prop_id, level, is_residential, type_desc, state_codes FROM voter LEFT JOIN best USING (vuid))"
)

_CITY = "CASE " + " ".join(f"WHEN ends_with(b, '{c}') THEN '{c}'" for c in CITIES) + " END"
FREEFORM = f"""WITH a AS (SELECT ord, zip, trim(regexp_replace(upper(concat_ws(' ', number, pre, name1, type, unit, ', Austin TX', zip)), '\\s+', ' ', 'g')) AS t FROM registration),
c AS (SELECT ord, zip, trim(regexp_replace(regexp_replace(t, '\\b\\d{{5}}$', ''), '\\bTX\\s*$', '')) AS b FROM (SELECT ord, zip, trim(regexp_replace(t, '\\b\\d{{5}}$', '')) AS t FROM a)),
d AS (SELECT ord, zip, b, {_CITY} AS city FROM c),
e AS (SELECT ord, zip, city, regexp_replace(trim(substr(b, 1, length(b) - length(city))), '[ ,-]+$', '') AS x FROM d),
f AS (SELECT ord, zip, city, regexp_extract(x, '^(\\d+[A-Z]?)\\b', 1) AS number, trim(regexp_replace(x, '^(\\d+[A-Z]?)\\b\\s*', '')) AS y FROM e),
g AS (SELECT *, regexp_extract(y, '\\bAPT\\s*#?\\s*([A-Z0-9-]+)\\b', 1) AS unit, trim(regexp_replace(y, '\\bAPT\\s*#?\\s*([A-Z0-9-]+)\\b', ' ')) AS s FROM f)
SELECT ord, number, {street_sql('s')} AS street, unit, city, zip FROM g"""

_EDR = "coalesce(try_strptime(edr, '%m/%d/%Y'), try_strptime(edr, '%Y%m%d'))"
HISTORY = "h AS (SELECT ord, " + " || ".join(
    f"(CASE WHEN ck % {k + 3} = 0 THEN 'R' WHEN ck % {k + 4} = 0 THEN 'D' WHEN {_EDR} <= DATE '{d}' - 30 THEN '_' ELSE '~' END)"
    for k, d in enumerate(PRIMARY_DATES)
) + " AS history FROM registration)"
