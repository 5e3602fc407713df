"""Test inputs derived from the given tables.

Each is one SQL text that Spark and DuckDB both run; ``{customer}`` and the like
stand for the tables.  Secret-looking text is put together from hashes.
"""

from __future__ import annotations

import re

CFG_LINES = """
select concat('cfg/', case c_custkey % 3 when 0 then 'app' when 1 then 'srv' else 'job' end, cast(c_nationkey as string),
 case c_custkey % 12 when 1 then '.json' when 9 then '.json' when 2 then '.xml' when 3 then '.config' when 4 then '.yaml' when 10 then '.yaml' when 11 then '.yml' else '.properties' end) as path,
 cast(c_custkey as int) as line_no,
 case c_custkey % 12
 when 0 then concat('db.password=pw-', substr(md5(cast(c_custkey as string)),1,12))
 when 1 then concat('  "apiKey": "', md5(cast(c_custkey as string)), '",')
 when 2 then concat('  <password>', substr(md5(cast(c_custkey as string)),1,10), '</password>')
 when 3 then concat('<add key="ConnectionString" value="Server=h', cast(c_nationkey as string), ';Id=', substr(md5(cast(c_custkey as string)),1,8), '"/>')
 when 4 then concat('timeout: ', cast(c_custkey as string))
 when 5 then 'token: changeme'
 when 6 then 'note = changeme'
 when 7 then concat('seed=', md5(cast(c_custkey as string)))
 when 8 then 'author=Jane'
 when 9 then '  "auth": {{'
 when 10 then 'password: |'
 else concat('endpoint: ', chr(39), 'https://h', cast(c_nationkey as string), '.example.org/x', chr(39)) end as line
from {customer}
"""

SHAPE_LINES = """
select concat('misc/', p_brand, '/f', cast(p_partkey % 40 as string), case p_partkey % 2 when 0 then '.txt' else '.env' end) as path, cast(p_partkey as int) as line_no,
 concat('see ', case p_partkey % 14
 when 0 then concat(cast(p_partkey % 250 as string), '.', cast(p_size as string), '.3.', cast(p_partkey % 9 as string))
 when 1 then concat('fe80:', substr(md5(cast(p_partkey as string)),1,4), ':0:1')
 when 2 then concat('ftp://u', cast(p_size as string), ':', substr(md5(cast(p_partkey as string)),1,9), '@h.example.org/p')
 when 3 then concat('https://h', cast(p_size as string), '.example.org/a')
 when 4 then concat('AK', 'IA', upper(substr(md5(cast(p_partkey as string)),1,16)))
 when 5 then concat('aws_secret_', 'access_key = "', md5(cast(p_partkey as string)), substr(md5(cast(p_size as string)),1,8), '"')
 when 6 then concat('gh', 'p_', md5(cast(p_partkey as string)), 'abcd')
 when 7 then concat('xo', 'xb-', substr(md5(cast(p_partkey as string)),1,14))
 when 8 then concat('ey', 'J', substr(md5(cast(p_partkey as string)),1,12), '.', substr(md5(cast(p_size as string)),1,12), '.', substr(md5(p_brand),1,12))
 when 9 then concat('Bearer ', md5(cast(p_partkey as string)))
 when 10 then 'Bearer YOUR_BEARER_TOKEN_HERE'
 when 11 then concat('-----BEGIN RSA PRIVATE', ' KEY-----', md5(cast(p_partkey as string)), '-----END RSA PRIVATE', ' KEY-----')
 when 12 then concat('u', cast(p_partkey as string), '@mail.example.org and v', cast(p_size as string), '@mail.example.org')
 else concat('127.0.0.1 then 10.0.0.', cast(p_size as string)) end, ' end') as line
from {part}
"""

CODE_LINES = """
select concat('src/', case o_orderkey % 9 when 0 then 'A.java' when 1 then 'b.py' when 2 then 'c.py' when 3 then 'd.ts' when 4 then 'e.go' when 5 then 'F.cs' when 6 then 'g.dart' when 7 then 'h.dart' else 'i.dart' end) as path, cast(o_orderkey as int) as line_no,
 case o_orderkey % 9
 when 0 then concat('String ', case (o_orderkey % 27 - o_orderkey % 9) / 9 when 0 then 'apiKey' when 1 then 'author' else 'dbPassword' end, ' = "', substr(md5(cast(o_orderkey as string)),1,14), '";')
 when 1 then concat(case o_custkey % 3 when 0 then 'api_key' when 1 then 'monkey' else 'keyAuthor' end, ' = ', chr(39), substr(md5(cast(o_orderkey as string)),1,14), chr(39))
 when 2 then concat('x = os.getenv("DB_PASSWORD", "', substr(md5(cast(o_orderkey as string)),1,14), '")')
 when 3 then concat('const authToken: string = "', substr(md5(cast(o_orderkey as string)),1,14), '";')
 when 4 then concat('secretKey := "', substr(md5(cast(o_orderkey as string)),1,14), '"')
 when 5 then concat('var clientSecret = "', substr(md5(cast(o_orderkey as string)),1,14), '";')
 when 6 then concat('final String? refreshToken = r', chr(39), substr(md5(cast(o_orderkey as string)),1,14), chr(39), ';')
 when 7 then concat('Options(apiKey: "', substr(md5(cast(o_orderkey as string)),1,14), '", n: 1)')
 else concat('final m = {{', chr(39), 'client_secret', chr(39), ': "', substr(md5(cast(o_orderkey as string)),1,14), '"}};') end as line
from {orders}
"""

BLOCK_FILES = """
select concat('blk/', cast(s_suppkey as string), case s_suppkey % 5 when 0 then '.py' when 1 then '.java' when 2 then '.go' else '.pem' end) as path,
 case s_suppkey % 5
 when 0 then concat('API_SECRET = (', chr(10), '    "', substr(md5(cast(s_suppkey as string)),1,8), '"', chr(10), '    "', substr(md5(s_name),1,8), '"', chr(10), ')', chr(10), 'x = 1', chr(10))
 when 1 then concat('  String authToken = "', substr(md5(cast(s_suppkey as string)),1,8), '" +', chr(10), '     "', substr(md5(s_name),1,8), '";', chr(10), '  int n = 1;', chr(10))
 when 2 then concat(case s_suppkey % 3 when 0 then 'var apiKey string = "' when 1 then 'apiKey := "' else 'var apiKey cfg.Key = "' end, substr(md5(cast(s_suppkey as string)),1,8), '"', chr(10), '  + "', substr(md5(s_name),1,case s_suppkey % 2 when 0 then 8 else 20 end), '"', chr(10), 'n := 1', chr(10))
 when 3 then concat('-----BEGIN RSA PRIVATE', ' KEY-----', chr(10), md5(cast(s_suppkey as string)), chr(10), md5(s_name), chr(10), '-----END RSA PRIVATE', ' KEY-----', chr(10), 'tail text', chr(10))
 else concat('-----BEGIN EC PRIVATE', ' KEY-----', chr(10), case (s_suppkey % 2) when 0 then md5(s_name) else 'prose, not key material.' end, chr(10), 'more prose here.', chr(10)) end as text
from {supplier}
"""

# one small file per line, so that a file stays small however much data there is
LINE_FILES = f"""
select concat('tree', cast(line_no % 7 as string), '/d', cast(line_no % 50 as string), '/n', cast(line_no as string),
 case when path like '%.env' then '/.env' else concat('_', regexp_extract(path, '[^/]*$', 0)) end) as path,
 concat('top of file', chr(10), line, chr(10)) as text, 2 as line_no, path as old_path, line
from (({CFG_LINES}) union all ({SHAPE_LINES}) union all ({CODE_LINES})) all_lines
"""

# identifiers of many forms
IDENTS = """
select c_custkey as id, concat(case c_custkey % 24
 when 0 then 'dbPassword' when 1 then 'apiKeyBackup' when 2 then 'monkey' when 3 then 'AUTHOR'
 when 4 then 'my_token2' when 5 then 'hostName' when 6 then 'URLPath' when 7 then 'passwordHash'
 when 8 then 'userSSNValue' when 9 then 'certificate' when 10 then 'authToken' when 11 then 'Api_Key'
 when 12 then 'clientSecret' when 13 then 'datasource.url' when 14 then 'db.username' when 15 then 'keystorePath'
 when 16 then 'xPrivateKeyId' when 17 then 'connStr' when 18 then 'connectionString' when 19 then 'SESSION_KEY'
 when 20 then 'tokenizer' when 21 then 'curious' when 22 then 'signingKey9' else 'ghost' end,
 case c_custkey % 5 when 0 then '' when 1 then '_x' when 2 then 'X' when 3 then '1' else 'x' end) as name
from {customer}
"""

# labels for the lines of shape files; some inverted, some on absent files
CASES = f"""
select concat('c', cast(line_no as string)) as id, case line_no % 31 when 0 then concat('gone/', path) else path end as file,
 cast(case line_no % 37 when 0 then 9 else 2 end as int) as line,
 case line_no % 3 when 0 then 'text' when 1 then 'env' else '' end as language, case line_no % 2 when 0 then '.txt' else '.env' end as file_type,
 concat('kind', cast(line_no % 14 as string)) as category,
 ((line_no % 14 in (10)) = (line_no % 29 = 0)) as expected_detection,
 substr(line, 5, length(line) - 8) as original_value,
 case line_no % 4 when 0 then 'see ***REDACTED*** end' else cast(null as string) end as expected_output_line,
 case when line_no % 14 = 3 then concat('g', cast(line_no % 5 as string)) else cast(null as string) end as value_group,
 case when line_no % 14 in (2, 3) then 'URL' when line_no % 14 in (6, 7, 8, 9) then 'ACCESS_TOKEN' else cast(null as string) end as expected_placeholder_category
from (select concat('n', cast(line_no as string), case line_no % 2 when 0 then '_f.txt' else '/.env' end) as path, line_no, line from ({SHAPE_LINES}) s0) s1
"""

CASE_FILES = f"""
select concat('n', cast(line_no as string), case line_no % 2 when 0 then '_f.txt' else '/.env' end) as path,
 concat('top of file', chr(10), line, chr(10)) as text, line from ({SHAPE_LINES}) s0
"""

# scores of paired answers, from the turns of conversations
SCORES = """
select case conv_id % 9 when 0 then 'java' when 1 then 'python' when 2 then 'javascript' when 3 then 'typescript' when 4 then 'go' when 5 then 'csharp' when 6 then 'json' when 7 then 'yaml' else 'properties' end as language,
 concat('conv', cast(conv_id as string)) as file,
 case (turn - turn % 2) / 2 % 6 when 0 then 'explain_code' when 1 then 'identify_bug' when 2 then 'security_analysis' when 3 then 'generate_unit_tests' when 4 then 'suggest_refactoring' else 'explain_config_relationships' end as task,
 case role when 'user' then 'original' else 'sanitized' end as condition,
 concat('r', cast(conv_id as string), '_', cast(turn as string)) as response_file,
 cast(1 + length(text) % 5 as int) as correctness,
 cast(1 + length(text) % 7 % 5 as int) as completeness,
 cast(1 + length(text) % 3 as int) as consistency,
 cast(3 + case when length(text) % 11 = 0 then 1 when length(text) % 13 = 0 then -1 else 0 end as int) as usefulness,
 case role when 'user' then cast(null as int) else cast(4 + length(text) % 2 as int) end as misunderstood_value,
 case when (turn - turn % 2) / 2 % 6 = 5 then cast(5 as int) else cast(null as int) end as relationships_preserved,
 case conv_id % 7 when 0 then 'none' when 1 then 'environmental_deviation' when 2 then 'missed_sanitization_independent_issue; environmental_deviation' when 3 then '' when 4 then 'inferred_placeholder_value;other_tag' else 'none' end as failure_modes,
 'n' as notes, 'none' as deviation
from {conversations} where role in ('user', 'assistant')
"""

SCANS = """
select user_id as project_id, event_id as scan_id, ts, cast(event_id % 50 as bigint) as total_redactions from {events}
"""

_TABLE = re.compile(r"\{(\w+)\}")


def tables(sql: str) -> list[str]:
    """The tables that a text reads, as often as it does."""
    return _TABLE.findall(sql.replace("{{", "").replace("}}", ""))


def for_spark(sql: str, folder: str) -> str:
    return _TABLE.sub(lambda m: f"parquet.`{folder}/{m[1]}.parquet`", sql.replace("{{", "\x00").replace("}}", "\x01")).replace("\x00", "{").replace("\x01", "}")


def for_duckdb(sql: str) -> str:
    return _TABLE.sub(lambda m: m[1], sql.replace("{{", "\x00").replace("}}", "\x01")).replace("\x00", "{").replace("\x01", "}")
