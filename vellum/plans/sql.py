"""DuckDB statements for the queries of registry.py, written apart from the operators they check."""

from __future__ import annotations

from vellum.plans.derive import REF_DATE

VALUES = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
REF = f"DATE '{REF_DATE}'"


def ck(x: str) -> str:
    """Check digit of x, as text; null for a character without a value."""
    value = f"(CASE WHEN substr({x}, i, 1) = '<' THEN 0 ELSE strpos('{VALUES}', substr({x}, i, 1)) - 1 END)"
    return f"(CASE WHEN {x} IS NULL OR regexp_matches({x}, '[^A-Z0-9<]') THEN NULL ELSE CAST(coalesce(list_sum(list_transform(range(1, length({x}) + 1), lambda i: {value} * [7, 3, 1][(i - 1) % 3 + 1])), 0) % 10 AS VARCHAR) END)"


def verify(x: str, d: str) -> str:
    return f"(CASE WHEN {d} IS NULL OR {d} = '' THEN NULL WHEN {d} = '<' THEN (CASE WHEN regexp_full_match(coalesce({x}, ''), '<*') THEN NULL ELSE false END) WHEN NOT regexp_full_match({d}, '[0-9]') THEN false ELSE coalesce({ck(x)} = {d}, false) END)"


def pad(x: str, n: int | str) -> str:
    return f"rpad(coalesce({x}, ''), CAST({n} AS INTEGER), '<')"


def cut(x: str, a: int, b: int) -> str:
    return f"substr({x}, {a + 1}, {b - a})"


NUM = lambda x: f"translate({x}, 'OQDUILJZASGTB', '0000111245678')"
ALPHA = lambda x: f"translate({x}, '01245678', 'OIZASGTB')"

FIELDS = """
fields AS (
  SELECT o_orderkey, ['TD3', 'TD2', 'TD1', 'MRV_A', 'MRV_B'][o_orderkey % 5 + 1] AS any_type, 'P' AS document_code,
    'U' || chr(65 + c_nationkey) || 'A' AS issuing_state, 'U' || chr(65 + c_nationkey) || 'A' AS nationality, c_mktsegment AS surname,
    'CUSTOMER ' || translate(CAST(c_custkey AS VARCHAR), '0123456789', 'ABCDEFGHIJ') AS given_names,
    'AB' || lpad(CAST(o_orderkey % 10000000 AS VARCHAR), 7, '0') AS document_number, strftime(o_orderdate, '%y%m%d') AS birth_date,
    CAST(o_orderkey % 15 + 20 AS VARCHAR) || strftime(o_orderdate, '%m%d') AS expiry_date, ['M', 'F', 'X', '<'][c_custkey % 4 + 1] AS sex,
    CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE left(c_mktsegment, 9) END AS optional_data
  FROM orders JOIN customer ON o_custkey = c_custkey
)"""


def encoded(kind: str) -> str:
    """CTE e: the lines of fields under the type in `kind`, a column of fields or a literal."""
    width = f"(CASE WHEN {kind} IN ('TD3', 'MRV_A') THEN 44 WHEN {kind} = 'TD1' THEN 30 ELSE 36 END)"
    optional = f"(CASE {kind} WHEN 'TD3' THEN 14 WHEN 'TD2' THEN 7 WHEN 'MRV_A' THEN 16 WHEN 'MRV_B' THEN 8 ELSE 15 END)"
    name = "replace(trim(regexp_replace(upper(surname), '[^A-Z ]', '', 'g')), ' ', '<') || '<<' || replace(trim(regexp_replace(upper(given_names), '[^A-Z ]', '', 'g')), ' ', '<')"
    return f"""
e0 AS (SELECT o_orderkey, {kind} AS mrz_type, {width} AS w, {pad('document_code', 2)} || issuing_state AS head, nationality AS nat, {name} AS nm, {pad('document_number', 9)} AS n, birth_date AS b, sex AS s, expiry_date AS x, {pad('optional_data', optional)} AS o FROM fields),
e1 AS (SELECT *, n || {ck('n')} AS nc, b || {ck('b')} AS bc, x || {ck('x')} AS xc, {ck('o')} AS oc FROM e0),
e2 AS (SELECT *, CASE WHEN mrz_type = 'TD1' THEN head || nc || o ELSE {pad('head || ' + pad('nm', 'w - 5'), 'w')} END AS line1,
  CASE WHEN mrz_type = 'TD1' THEN bc || s || xc || nat || '<<<<<<<<<<<' WHEN mrz_type = 'TD3' THEN nc || nat || bc || s || xc || o || oc ELSE nc || nat || bc || s || xc || o END AS l2 FROM e1),
e3 AS (SELECT *, CASE mrz_type WHEN 'TD1' THEN {cut('line1', 5, 30)} || {cut('l2', 0, 7)} || {cut('l2', 8, 15)} || {cut('l2', 18, 29)}
  WHEN 'TD3' THEN {cut('l2', 0, 10)} || {cut('l2', 13, 20)} || {cut('l2', 21, 43)} WHEN 'TD2' THEN {cut('l2', 0, 10)} || {cut('l2', 13, 20)} || {cut('l2', 21, 35)} END AS comp FROM e2),
e AS (SELECT o_orderkey, mrz_type, line1, {pad(f"l2 || coalesce({ck('comp')}, '')", 'w')} AS line2, CASE WHEN mrz_type = 'TD1' THEN {pad('nm', 30)} END AS line3 FROM e3)"""


def plus_one(at: int) -> str:
    return f"CAST((CAST(substr(line2, {at + 1}, 1) AS INTEGER) + 1) % 10 AS VARCHAR)"


DAMAGED = f"""
z AS (
  SELECT o_orderkey, CAST(o_orderkey % 8 AS INTEGER) AS damage,
    CASE o_orderkey % 8 WHEN 4 THEN left(line1, 40) WHEN 7 THEN left(line1, 2) || 'D<<' || substr(line1, 6) ELSE line1 END AS l1,
    CASE o_orderkey % 8 WHEN 1 THEN left(line2, 2) || {ALPHA('substr(line2, 3, 1)')} || substr(line2, 4)
      WHEN 2 THEN left(line2, 9) || {plus_one(9)} || substr(line2, 11) WHEN 3 THEN left(line2, 20) || '9' || substr(line2, 22)
      WHEN 5 THEN left(line2, 13) || {ALPHA('substr(line2, 14, 6)')} || substr(line2, 20) WHEN 6 THEN left(line2, 43) || {plus_one(43)} ELSE line2 END AS l2
  FROM e
)"""

#: CTE d: TD3 zones z decoded. Numbers are repaired by building every string one or two swaps away.
_KINDS = ((9, 10, "num"), (10, 13, "alpha"), (13, 19, "date"), (19, 20, "num"), (20, 21, "sex"), (21, 27, "date"), (27, 28, "num"))
_SEX = "(CASE WHEN substr(l2, 21, 1) IN ('M', 'F', 'X') THEN substr(l2, 21, 1) WHEN substr(l2, 21, 1) = 'H' THEN 'M' ELSE '<' END)"
_coerced = lambda a, b, k: _SEX if k == "sex" else (ALPHA if k == "alpha" else NUM)(cut("l2", a, b))
_LINE1 = "rpad(l1, 44, '<')"
_changed1 = f"CASE WHEN {ALPHA(cut('p1', 0, 2))} <> {cut('p1', 0, 2)} THEN 'line1:doc_code' END, CASE WHEN {ALPHA(cut('p1', 2, 5))} <> {cut('p1', 2, 5)} THEN 'line1:alpha' END"
_changed2 = ", ".join(f"CASE WHEN {_coerced(a, b, k)} <> {cut('l2', a, b)} THEN 'line2:{k}' END" for a, b, k in _KINDS)
DECODED = f"""
d0 AS (SELECT o_orderkey, damage, {_LINE1} AS p1, l2 FROM z),
d1 AS (SELECT o_orderkey, damage, {ALPHA(cut('p1', 0, 5))} || substr(p1, 6) AS p1, left(l2, 9) || {' || '.join(_coerced(*k) for k in _KINDS)} || substr(l2, 29) AS l2,
  list_filter([{_changed1}, {_changed2}], lambda c: c IS NOT NULL) AS fixes FROM d0),
d2 AS (SELECT *, left(l2, 9) AS n, substr(l2, 10, 1) AS ncd FROM d1),
swap(c, alt) AS (VALUES ('0','O'),('O','0'),('1','I'),('I','1'),('2','Z'),('Z','2'),('4','A'),('A','4'),('5','S'),('S','5'),('6','G'),('G','6'),('7','T'),('T','7'),('8','B'),('B','8'),('Q','0'),('D','0'),('U','0'),('L','1'),('J','1')),
wrong AS (SELECT o_orderkey, n, ncd FROM d2 WHERE regexp_full_match(ncd, '[0-9]') AND coalesce({ck('n')} <> ncd, true)),
places AS (SELECT o_orderkey, n, ncd, i, alt FROM wrong, range(1, 10) r(i), swap WHERE substr(n, i, 1) = c),
one AS (SELECT o_orderkey, left(n, i - 1) || alt || substr(n, i + 1) AS v, ncd FROM places),
one_ok AS (SELECT o_orderkey, v FROM one WHERE {ck('v')} = ncd),
two AS (SELECT a.o_orderkey, left(a.n, a.i - 1) || a.alt || substr(a.n, a.i + 1, b.i - a.i - 1) || b.alt || substr(a.n, b.i + 1) AS v, a.ncd FROM places a JOIN places b ON a.o_orderkey = b.o_orderkey AND a.i < b.i WHERE a.o_orderkey NOT IN (SELECT o_orderkey FROM one_ok)),
ways AS (SELECT o_orderkey, min(v) AS v, count(*) AS ways FROM (SELECT * FROM one_ok UNION ALL SELECT o_orderkey, v FROM two WHERE {ck('v')} = ncd) GROUP BY o_orderkey),
d3 AS (SELECT d2.*, CASE WHEN ways = 1 THEN v ELSE n END AS number, coalesce(ways = 1, false) AS fixed, coalesce(ways > 1, false) AS ambiguous FROM d2 LEFT JOIN ways ON ways.o_orderkey = d2.o_orderkey),
d4 AS (SELECT *, number || ncd || {cut('l2', 13, 20)} || {cut('l2', 21, 43)} AS comp, {cut('l2', 13, 19)} AS birth_date, substr(l2, 20, 1) AS bcd, {cut('l2', 21, 27)} AS expiry_date, substr(l2, 28, 1) AS xcd,
  {cut('l2', 28, 42)} AS o, substr(l2, 43, 1) AS ocd, substr(l2, 44, 1) AS ccd, rtrim(substr(p1, 6), '<') AS nm FROM d3),
d5 AS (SELECT *, {verify('number', 'ncd')} AS check_document_number, {verify('birth_date', 'bcd')} AS check_birth_date, {verify('expiry_date', 'xcd')} AS check_expiry_date, {verify('o', 'ocd')} AS check_optional_data, {verify('comp', 'ccd')} AS check_composite,
  replace(left(p1, 2), '<', '') AS document_code, trim(replace(substr(p1, 3, 3), '<', ' ')) AS issuing_state, trim(replace(number, '<', ' ')) AS document_number, trim(replace(substr(l2, 11, 3), '<', ' ')) AS nationality,
  nullif(substr(l2, 21, 1), '<') AS sex, trim(replace(o, '<', ' ')) AS optional_data, CASE WHEN contains(nm, '<<') THEN split_part(nm, '<<', 1) ELSE nm END AS sn, CASE WHEN contains(nm, '<<') THEN substr(nm, strpos(nm, '<<') + 2) ELSE '' END AS gn FROM d4),
d6 AS (SELECT *, trim(regexp_replace(replace(sn, '<', ' '), ' +', ' ', 'g')) AS surname, trim(regexp_replace(replace(gn, '<', ' '), ' +', ' ', 'g')) AS given_names,
  list_filter([check_document_number, check_birth_date, check_expiry_date, check_optional_data, check_composite], lambda c: c IS NOT NULL) AS defined,
  list_concat(fixes, CASE WHEN fixed THEN ['document_number:check_digit_repair'] ELSE [] END) AS corrections FROM d5),
d AS (SELECT *, len(defined) > 0 AND len(list_filter(defined, lambda c: c)) = len(defined) AS check_digits_valid, CASE WHEN len(defined) > 0 THEN len(list_filter(defined, lambda c: c)) / len(defined) ELSE 0.0 END AS check_digit_score,
  regexp_matches(document_code, '^[A-Z]') AND regexp_full_match(issuing_state, '[A-Z]{{3}}') AND document_number <> '' AND regexp_full_match(birth_date, '[0-9]{{2}}(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])') AND regexp_full_match(expiry_date, '[0-9]{{2}}(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])') AS structure_valid FROM d6)"""

TD3 = f"WITH {FIELDS}, {encoded(chr(39) + 'TD3' + chr(39))}, {DAMAGED}, {DECODED}"
