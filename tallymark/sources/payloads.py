"""Text payloads built from base columns, in SQL both engines read the same way.

These only bind the test tables to the nested inputs (web-hook bodies, asset
documents, scanned files); they hold no operator logic.
"""

from __future__ import annotations

from tallymark.operators.quality import SCHEMA_VERSIONS

INTAKE_PAYLOAD = """CONCAT('{"id":"pg_', CAST(c_custkey AS VARCHAR(20)), '","properties":{',
 CASE c_custkey % 5 WHEN 0 THEN '"Name":{"title":[]},' WHEN 1 THEN '"Name":{"title":[{"plain_text":""}]},'
   WHEN 2 THEN '' ELSE CONCAT('"Name":{"title":[{"plain_text":"', c_name, '"}]},') END,
 CASE c_custkey % 3 WHEN 0 THEN '"Sponsor":{"email":null},'
   ELSE CONCAT('"Sponsor":{"email":"u', CAST(c_custkey AS VARCHAR(20)), '@example.com"},') END,
 CASE c_custkey % 4 WHEN 0 THEN '"Budget":{"number":0},' WHEN 1 THEN ''
   ELSE CONCAT('"Budget":{"number":', CAST(c_custkey * 10 AS VARCHAR(20)), '.5},') END,
 CASE c_custkey % 6 WHEN 0 THEN '"StartDate":{"date":null},'
   ELSE CONCAT('"StartDate":{"date":{"start":"2024-01-', LPAD(CAST(1 + c_custkey % 28 AS VARCHAR(20)), 2, '0'), '"}},') END,
 '"Description":{"rich_text":[{"plain_text":"', c_mktsegment, '"},{"plain_text":"more"}]},',
 CASE c_custkey % 7 WHEN 0 THEN '"Priority":{}' WHEN 1 THEN '"Priority":{"select":null}'
   ELSE '"Priority":{"select":{"name":"High"}}' END, '}}')"""

OCR_PAYLOAD = """CONCAT('{"tables":[{"type":"invoice","vendor":"V', CAST(o_custkey AS VARCHAR(20)), '","total":"',
 CASE o_orderkey % 4 WHEN 0 THEN CONCAT(CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR(20)), ' EUR')
   WHEN 1 THEN 'n/a' WHEN 2 THEN CONCAT('  ', CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR(20)))
   ELSE CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR(20)) END,
 '","date":"', CAST(CAST(o_orderdate AS DATE) AS VARCHAR(20)), '","items":[',
 CASE SUBSTR(o_orderpriority, 1, 1) WHEN '1' THEN '' WHEN '2' THEN '{"sku":"A","qty":1}'
   WHEN '3' THEN '{"sku":"A","qty":1},{"sku":"B","qty":2}'
   ELSE '{"sku":"C","qty":3},{"sku":"D","qty":4},{"sku":"E","qty":5}' END,
 ']},{"type":"summary","vendor":"S","total":"1","date":"2000-01-01","items":[{"sku":"Z","qty":9}]}]}')"""

BUNDLE_TYPE = """CASE p_partkey % 4 WHEN 0 THEN 'databases' WHEN 1 THEN 'datasets'
 WHEN 2 THEN 'charts' ELSE 'dashboards' END"""

BUNDLE_DOC = f"""CASE WHEN p_size = 13 THEN '[1,2]' ELSE CONCAT('{{"owner":"', p_brand, '"',
 CASE WHEN p_size % 10 = 0 THEN '' WHEN p_size % 7 = 0 THEN ',"version":"2.0"' ELSE ',"version":"1.0"' END,
 CASE WHEN p_size % 9 = 0 THEN ',"schema_version":"other_v9"' ELSE CONCAT(',"schema_version":"',
   CASE p_partkey % 4 WHEN 0 THEN '{SCHEMA_VERSIONS["databases"]}' WHEN 1 THEN '{SCHEMA_VERSIONS["datasets"]}'
     WHEN 2 THEN '{SCHEMA_VERSIONS["charts"]}' ELSE '{SCHEMA_VERSIONS["dashboards"]}' END, '"') END,
 CASE p_partkey % 4
   WHEN 0 THEN CONCAT(',"database_name":"db"', CASE WHEN p_size % 6 = 0 THEN '' ELSE ',"sqlalchemy_uri":"x"' END)
   WHEN 1 THEN CONCAT(',"table_name":"t"', CASE WHEN p_size % 6 = 0 THEN '' ELSE ',"database_id":1' END)
   WHEN 2 THEN CONCAT(',"slice_name":"s","params":{{}}', CASE WHEN p_size % 6 = 0 THEN '' ELSE ',"viz_type":"pie"' END)
   ELSE CONCAT(',"dashboard_title":"d"', CASE WHEN p_size % 6 = 0 THEN '' ELSE ',"position_json":null' END) END,
 '}}') END"""

ASSET_CONTENT = "CONCAT(p_name, '|', p_brand, '|', CAST({size} AS VARCHAR(20)))"
ASSET_TYPE = "CASE p_partkey % 4 WHEN 0 THEN 'database' WHEN 1 THEN 'dataset' WHEN 2 THEN 'chart' ELSE 'dashboard' END"

COMMAND_TEXT = """CASE event_id % 16 WHEN 0 THEN CONCAT('cat notes_', CAST(user_id AS VARCHAR(20)), '.txt')
 WHEN 1 THEN 'head -n 5 log.txt' WHEN 2 THEN 'find . -name x.py' WHEN 3 THEN 'ls -la -R /tmp'
 WHEN 4 THEN 'grep -r foo .' WHEN 5 THEN 'rg foo' WHEN 6 THEN 'sed -i s/a/b/ f' WHEN 7 THEN 'perl -pi -e 1 f'
 WHEN 8 THEN 'echo hi > f' WHEN 9 THEN 'cat << EOF' WHEN 10 THEN 'git grep foo' WHEN 11 THEN 'docker ps'
 WHEN 12 THEN 'npm run cat' WHEN 13 THEN 'python run.py' WHEN 14 THEN 'printf x > y' ELSE 'ls -la' END"""

# One configuration block is appended to every document, so the scanners have
# connection strings to find in text that grows with the table.
CORPUS_PATH = """CONCAT(CASE doc_id % 4 WHEN 0 THEN '/repo/prod/' WHEN 1 THEN '/repo/.github/workflows/'
 WHEN 2 THEN '/repo/staging/k8s/' ELSE '/repo/app/' END, source, '/', lang, '_', CAST(doc_id AS VARCHAR(20)),
 CASE doc_id % 7 WHEN 0 THEN '.env' WHEN 1 THEN '.md' WHEN 2 THEN '.tf' WHEN 3 THEN '.yaml'
   WHEN 4 THEN '.toml' WHEN 5 THEN '.prisma' ELSE '.txt' END)"""

CORPUS_BLOCK = """CASE doc_id % 6
 WHEN 0 THEN CONCAT('DATABASE_URL=postgresql://svc_', source, ':pw', CAST(doc_id AS VARCHAR(20)), '@DB-', lang,
   '.example.com:5432/app_', source, '?sslmode=require')
 WHEN 1 THEN CONCAT('cache = redis://cache-', lang, '.example.com:6379/0?token=abc', CAST(doc_id AS VARCHAR(20)))
 WHEN 2 THEN CONCAT('DB_HOST=host-', lang, '.example.com', CHR(10), 'DB_PORT=3306', CHR(10), 'DB_NAME=shop_', source,
   CHR(10), 'DB_PASSWORD=s3cret', CAST(doc_id AS VARCHAR(20)))
 WHEN 3 THEN CONCAT('export PGHOST="pg-', lang, '.example.com"', CHR(10), 'PGDATABASE=dw_', source, CHR(10), 'PGUSER=reader')
 WHEN 4 THEN CONCAT('store kept at data/', source, '.sqlite3 today')
 ELSE CONCAT('url: https://abcdefghij', lang, '.supabase.co end') END"""
