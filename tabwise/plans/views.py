"""Views with the dirt that the operators are made for, in SQL both engines understand."""

DAY = "lpad(CAST(day(o_orderdate) AS STRING), 2, '0')"
MONTH = "lpad(CAST(month(o_orderdate) AS STRING), 2, '0')"
YEAR = "CAST(year(o_orderdate) AS STRING)"

# Orders with gaps in a number and in two categories, below and above thirty percent.
GAPPY = """SELECT o_orderkey AS _row_id, o_custkey, o_orderkey,
CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price,
CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE exp(o_totalprice / 60000.0) END AS skewed,
CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_custkey END AS whole,
CASE WHEN o_orderkey % 11 = 0 THEN '' WHEN o_orderkey % 13 = 0 THEN 'nan' ELSE o_orderpriority END AS priority,
CASE WHEN o_orderkey % 10 < 4 THEN NULL ELSE o_orderstatus END AS state
FROM orders"""

# Everything as text: money, flags, dates in three shapes, categories, free keys.
TEXTS = f"""SELECT o_orderkey AS _row_id,
concat('$', CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING)) AS money,
CASE o_orderstatus WHEN 'F' THEN 'Yes' ELSE 'no' END AS flag,
concat({DAY}, '/', {MONTH}, '/', {YEAR}) AS day_first,
concat({YEAR}, '-', {MONTH}, '-', {DAY}) AS iso,
CASE WHEN day(o_orderdate) <= 12 THEN concat({DAY}, '.', {MONTH}, '.', {YEAR}) END AS vague,
concat(' ', o_orderpriority, ' ') AS priority,
concat('O-', CAST(o_orderkey AS STRING)) AS code_text,
CASE WHEN o_orderkey % 3 = 0 THEN 'nan' ELSE CAST(o_custkey AS STRING) END AS mostly_number
FROM orders"""
TEXT_COLUMNS = ["money", "flag", "day_first", "iso", "vague", "priority", "code_text", "mostly_number"]

# Orders plus copies of every fiftieth row.
COPIES = """SELECT o_orderkey * 2 AS _row_id, o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders
UNION ALL
SELECT o_orderkey * 2 + 1, o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 50 = 0"""

# Customers with personal data under neutral headers.
PEOPLE = """SELECT c_custkey AS _row_id,
concat('u', CAST(c_custkey AS STRING), '@example.com') AS col_a,
concat('555-', lpad(CAST(c_custkey % 1000 AS STRING), 3, '0'), '-', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0')) AS col_b,
concat('4000-1234-', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0'), '-', lpad(CAST(c_custkey % 7919 AS STRING), 4, '0')) AS col_c,
concat('123-45-', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0')) AS col_d,
CASE WHEN c_custkey % 3 = 0 THEN concat('v', CAST(c_custkey AS STRING), '@example.org') ELSE c_mktsegment END AS col_e,
concat('$', CAST(CAST(floor(c_acctbal) AS BIGINT) AS STRING)) AS col_f,
c_mktsegment AS col_g
FROM customer"""
PEOPLE_COLUMNS = ["col_a", "col_b", "col_c", "col_d", "col_e", "col_f", "col_g"]

# Customers as a table somebody may ask about.
CLIENTS = """SELECT c_custkey AS customer_id, concat('u', CAST(c_custkey AS STRING), '@example.com') AS email,
c_name AS full_name, c_acctbal AS balance, c_mktsegment AS segment, c_nationkey AS nation_no FROM customer"""
