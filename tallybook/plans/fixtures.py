"""Inputs of the queries, derived from the given tables in SQL that both engines read alike."""

_CENTS = "SELECT p_partkey AS id, CAST(round(p_retailprice * 100) AS BIGINT) AS c FROM {part}"
_PARTS = f"""SELECT id, c, CAST(CAST(floor(c / 100.0) AS BIGINT) AS STRING) AS ip, lpad(CAST(c % 100 AS STRING), 2, '0') AS fp,
  CAST(CAST(floor(c / 100000.0) AS BIGINT) AS STRING) AS th, lpad(CAST(CAST(floor(c / 100.0) AS BIGINT) % 1000 AS STRING), 3, '0') AS hu FROM ({_CENTS}) x"""

#: Amounts as text in a dozen notations: a, and b of nearly the same value.
AMOUNTS = f"""SELECT id,
  CASE id % 13 WHEN 0 THEN concat(ip, '.', fp) WHEN 1 THEN concat(th, ',', hu, '.', fp) WHEN 2 THEN concat(th, '.', hu, ',', fp)
    WHEN 3 THEN concat(th, ' ', hu, ',', fp) WHEN 4 THEN concat('€', th, '.', hu, ',', fp) WHEN 5 THEN ip WHEN 6 THEN concat(th, '.', hu)
    WHEN 7 THEN concat(ip, '%') WHEN 8 THEN concat('–', ip, '.', fp) WHEN 9 THEN concat(ip, '.', fp, 'e2') WHEN 10 THEN ''
    WHEN 11 THEN concat(ip, ',', fp, '-', ip, ',99') ELSE NULL END AS a,
  CASE id % 7 WHEN 0 THEN concat(ip, ',', fp) WHEN 1 THEN concat(ip, '.', fp) WHEN 2 THEN concat(CAST(CAST(ip AS BIGINT) + 1 AS STRING), '.', fp)
    WHEN 3 THEN concat(th, ',', hu, '.', fp) WHEN 4 THEN '0' WHEN 5 THEN concat(ip, '.', fp, '4') ELSE concat('0,', hu) END AS b
  FROM ({_PARTS}) y"""

#: References with separators and scan errors: raw and other.
REFS = """SELECT p_partkey AS id,
  CASE p_partkey % 6 WHEN 0 THEN concat('AB-', lpad(CAST(p_partkey AS STRING), 5, '0'), '_S') WHEN 1 THEN concat('ab ', lpad(CAST(p_partkey AS STRING), 5, '0'), ' s')
    WHEN 2 THEN concat('Ab/', lpad(CAST(p_partkey AS STRING), 5, '0'), 'S') WHEN 3 THEN concat('1. AB', CAST(p_partkey AS STRING), '.S')
    WHEN 4 THEN '' ELSE NULL END AS raw,
  CASE p_partkey % 5 WHEN 0 THEN concat('AB', lpad(CAST(p_partkey AS STRING), 5, '0'), 'S') WHEN 1 THEN concat('AB', replace(lpad(CAST(p_partkey AS STRING), 5, '0'), '0', 'O'), 'S')
    WHEN 2 THEN concat('AB', CAST(p_partkey AS STRING), 'S') WHEN 3 THEN concat('AB', replace(lpad(CAST(p_partkey AS STRING), 5, '0'), '1', 'I'), 'S')
    ELSE concat('AB', lpad(CAST(p_partkey + 1 AS STRING), 5, '0'), 'S') END AS other
  FROM {part}"""

#: Dates as text, a and b of the same day or of another.
DATES = """SELECT id, CAST(d AS STRING) AS iso,
  CASE id % 8 WHEN 0 THEN concat(y, '-', m, '-', dd) WHEN 1 THEN concat(dd, '.', m, '.', y) WHEN 2 THEN concat(dd, '/', m, '/', y) WHEN 3 THEN concat(m, '/', dd, '/', y)
    WHEN 4 THEN concat(y, '/', m, '/', dd) WHEN 5 THEN concat(y, '.', m, '.', dd) WHEN 6 THEN concat('date: ', dd, '-', m, '-', y, ' x') ELSE concat(dd, '.13.', y) END AS a,
  CASE id % 3 WHEN 0 THEN concat(y, '-', m, '-', dd) WHEN 1 THEN concat(m, '/', dd, '/', y) ELSE concat('01.01.', y) END AS b
  FROM (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS d, CAST(year(o_orderdate) AS STRING) AS y,
    lpad(CAST(month(o_orderdate) AS STRING), 2, '0') AS m, lpad(CAST(day(o_orderdate) AS STRING), 2, '0') AS dd FROM {orders}) x"""

#: Barcodes: twelve digits and a check digit that is right for two of three, in several lengths.
CODES = """SELECT id, CASE id % 6 WHEN 0 THEN concat(b, k) WHEN 1 THEN concat(b, k) WHEN 2 THEN concat(b, CAST((CAST(k AS INT) + 1) % 10 AS STRING))
    WHEN 3 THEN concat('0', b, k) WHEN 4 THEN substring(b, 1, 8) ELSE concat(substring(b, 1, 6), ' ', substring(b, 7, 6)) END AS code, b, k
  FROM (SELECT id, b, CAST((10 - (s % 10)) % 10 AS STRING) AS k FROM (SELECT id, b,
    CAST(substring(b, 1, 1) AS INT) + 3 * CAST(substring(b, 2, 1) AS INT) + CAST(substring(b, 3, 1) AS INT) + 3 * CAST(substring(b, 4, 1) AS INT) + CAST(substring(b, 5, 1) AS INT) + 3 * CAST(substring(b, 6, 1) AS INT)
    + CAST(substring(b, 7, 1) AS INT) + 3 * CAST(substring(b, 8, 1) AS INT) + CAST(substring(b, 9, 1) AS INT) + 3 * CAST(substring(b, 10, 1) AS INT) + CAST(substring(b, 11, 1) AS INT) + 3 * CAST(substring(b, 12, 1) AS INT) AS s
    FROM (SELECT p_partkey AS id, concat('590', lpad(CAST(p_partkey * 37 + 11 AS STRING), 9, '0')) AS b FROM {part}) x) y) z"""

#: Line items of document A: one for each order and part, with exact decimal quantity and amount.
ITEMS_A = """SELECT l_orderkey AS doc, l_partkey AS part, concat('AB', lpad(CAST(l_partkey AS STRING), 6, '0')) AS ref,
  SUM(CAST(l_quantity AS DECIMAL(18,2))) AS qty, SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS net, MIN(l_linenumber) AS line,
  CASE l_partkey % 3 WHEN 0 THEN 'PCS' WHEN 1 THEN 'CTN' ELSE 'OP' END AS unit
  FROM {lineitem} GROUP BY l_orderkey, l_partkey"""

#: Document B: some items left out, changed or added.
ITEMS_B = f"""SELECT doc, part, CASE WHEN k = 5 THEN concat(ref, 'X') ELSE ref END AS ref,
  CAST(CASE WHEN k = 1 THEN qty + 1 ELSE qty END AS DECIMAL(18,2)) AS qty,
  CAST(CASE WHEN k = 2 THEN round(net * 1.001, 2) WHEN k = 3 THEN round(net * 1.01, 2) WHEN k = 4 THEN round(net * 1.05, 2) ELSE net END AS DECIMAL(18,2)) AS net,
  line, CASE WHEN k = 6 THEN 'SET' ELSE unit END AS unit
  FROM (SELECT *, (doc * 7 + part) % 20 AS k FROM ({ITEMS_A}) a) x WHERE k <> 0"""
