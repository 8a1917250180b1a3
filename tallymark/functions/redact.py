"""Secret redaction and connection-string parsing as Spark SQL expressions.

The builders take the SQL text of a value and give SQL text, because these
expressions are long: one parsed text is planned far faster than thousands of
Column calls. Patterns write quotes as x27 and x22 escapes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = "***REDACTED***"

# Patterns and word lists that decide what counts as a secret.
URL_PATTERN = r"(?i)\b([a-z][a-z0-9+.-]*://[^\s\x27\x22)]+)"
SECRET_WORDS = r"password|passwd|pwd|token|api[_-]?key|service[_-]?role|secret|private[_-]?key"
SECRET_HINTS = ("passw", "pwd", "token", "api", "service", "secret", "private")
JWT_PATTERN = r"\beyJ[a-zA-Z0-9_-]{10,}\.[a-zA-Z0-9_-]{10,}\.[a-zA-Z0-9_-]{10,}\b"
SENSITIVE_KEY = r"(?i)pass|token|secret|key|^pwd$|^service_role$"
# Schemes whose URLs keep '//' even without a host.
HOST_SCHEMES = ("file", "ftp", "http", "https", "sftp", "git", "svn", "ws", "wss")
# URL scheme to datastore type.
SCHEMES = {"postgres": "postgres", "postgresql": "postgres", "mysql": "mysql", "mariadb": "mysql", "mssql": "mssql",
           "sqlserver": "mssql", "redis": "redis", "mongodb": "mongo", "clickhouse": "clickhouse",
           "elasticsearch": "elasticsearch", "opensearch": "opensearch"}

SECRET_VALUES = {
    "reference": r"[^\s\x27\x22,)]+",
    "quoted": r"(?:\x22[^\x22]*\x22|\x27[^\x27]*\x27|[^\s\x27\x22,)]+)",
}
_NONE = "CAST(array() AS ARRAY<STRING>)"


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _cut(value: str, pattern: str) -> str:
    return f"regexp_extract({value}, r'{pattern}', 1)"


def url_parts_sql(url: str) -> str:
    """struct of scheme (lower case), netloc, userinfo, hostinfo, path, fragment and decoded query pairs."""
    lead = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?"

    def decoded(value: str) -> str:
        return f"coalesce(try_url_decode({value}), {value})"

    query = _cut(url, r"^[^?#]*\?([^#]*)")
    key, value = decoded(_cut("s", r"^([^=]*)")), decoded(_cut("s", r"^[^=]*=([\s\S]*)$"))
    pairs = f"transform(filter(split({query}, '&'), s -> s <> ''), s -> named_struct('k', {key}, 'v', {value}))"
    return (f"named_struct('scheme', lower({_cut(url, '^([A-Za-z][A-Za-z0-9+.-]*):')}), 'netloc', {_cut(url, lead + '//([^/?#]*)')},"
            f" 'userinfo', {_cut(url, lead + '//([^/?#]*)@')}, 'hostinfo', {_cut(url, lead + '//(?:[^/?#]*@)?([^/?#]*)')},"
            f" 'path', {_cut(url, lead + '(?://[^/?#]*)?([^?#]*)')}, 'fragment', {_cut(url, '^[^#]*#(.*)$')}, 'pairs', {pairs})")


def redact_url_sql(url: str) -> str:
    """struct(text, fields): password and sensitive query values masked, and what was masked."""
    hosts = ", ".join(f"'{h}'" for h in HOST_SCHEMES)
    user = _cut("p.userinfo", "^([^:]*)")
    query = (f"array_join(transform(p.pairs, x -> concat(x.k, '=', CASE WHEN x.k RLIKE r'{SENSITIVE_KEY}' THEN '{MASK}' ELSE x.v END)),"
             " '&')")
    text = ("concat(CASE WHEN p.scheme <> '' THEN concat(p.scheme, ':') ELSE '' END,"
            f" CASE WHEN p.netloc <> '' OR p.scheme IN ({hosts}) OR startswith(p.path, '//') THEN '//' ELSE '' END,"
            f" CASE WHEN contains(p.userinfo, ':') THEN concat({user}, ':{MASK}@', p.hostinfo) ELSE p.netloc END, p.path,"
            f" CASE WHEN size(p.pairs) > 0 THEN concat('?', {query}) ELSE '' END,"
            " CASE WHEN p.fragment <> '' THEN concat('#', p.fragment) ELSE '' END)")
    fields = (f"array_sort(array_distinct(concat(CASE WHEN contains(p.userinfo, ':') THEN array('url_password') ELSE {_NONE} END,"
              f" transform(filter(p.pairs, x -> x.k RLIKE r'{SENSITIVE_KEY}'), x -> concat('query:', x.k)))))")
    return _let("p", url_parts_sql(url), f"named_struct('text', {text}, 'fields', {fields})")


def inline_pattern(mode: str = "reference") -> str:
    """``reference`` leaves quoted values alone; ``quoted`` masks them too."""
    return rf"(?iU)\b({SECRET_WORDS})\b\s*[:=]\s*{SECRET_VALUES[mode]}"


def redact_inline_sql(text: str, mode: str = "reference") -> str:
    """struct(text, fields) for ``key = value`` secrets, then token-like blobs."""
    pattern = inline_pattern(mode)
    start = (f"named_struct('out', regexp_replace({text}, r'{pattern}', '$1={MASK}'),"
             f" 'found', regexp_extract_all({text}, r'{pattern}', 1))")
    full = _let("m", start, f"named_struct('text', regexp_replace(m.out, r'{JWT_PATTERN}', '{MASK}'), 'fields', array_sort("
                f"array_distinct(concat(m.found, CASE WHEN m.out RLIKE r'{JWT_PATTERN}' THEN array('jwt') ELSE {_NONE} END))))")
    # a byte search that every text with a secret passes; U+017F is the one letter that folds to 's' only in the pattern
    hints = " OR ".join(f"contains(l, '{w}')" for w in SECRET_HINTS)
    maybe = _let("l", f"lower({text})", hints)
    return (f"CASE WHEN {maybe} OR contains({text}, 'eyJ') OR contains({text}, '\u017F') THEN {full}"
            f" ELSE named_struct('text', {text}, 'fields', {_NONE}) END")


def redact_text_sql(text: str, mode: str = "reference") -> str:
    """struct(text, fields): URLs first, inline secrets second.

    The text between URLs is kept and each URL is replaced by its redacted
    form. Texts without '://' skip that part.
    """
    found = f"transform(regexp_extract_all({text}, r'{URL_PATTERN}', 1), u -> {redact_url_sql('u')})"
    pieces = f"zip_with(split({text}, r'{URL_PATTERN}', -1), us, (b, r) -> concat(b, coalesce(r.text, '')))"
    masked = _let("us", found, f"named_struct('text', array_join({pieces}, ''), 'fields', flatten(transform(us, r -> r.fields)))")
    plain = f"CASE WHEN contains({text}, '://') THEN {masked} ELSE named_struct('text', {text}, 'fields', {_NONE}) END"
    step = f"named_struct('fields', w.fields, 'inline', {redact_inline_sql('w.text', mode)})"
    both = "named_struct('text', y.inline.text, 'fields', array_sort(array_distinct(concat(y.fields, y.inline.fields))))"
    return _let("w", plain, _let("y", step, both))


def parse_db_url_sql(url: str, driver_suffix: bool = False) -> str:
    """struct(datastore_type, host, port, database, user, ssl_mode); an unusable port is null.

    ``driver_suffix`` reads ``scheme+driver`` as the scheme; without it such a URL has an unknown type.
    """
    scheme = "regexp_replace(p.scheme, r'[+].*$', '')" if driver_suffix else "p.scheme"
    types = ", ".join(f"'{k}', '{v}'" for k, v in SCHEMES.items())
    bracketed, plain = _cut("p.hostinfo", r"^\[([^\]]*)"), _cut("p.hostinfo", r"^([^:\[]*)")
    port = f"TRY_CAST({_cut('p.hostinfo', r'^(?:\[[^\]]*\]|[^:\[]*):(\d+)$')} AS INT)"
    body = (f"named_struct('datastore_type', coalesce(try_element_at(map({types}), {scheme}), 'unknown'),"
            f" 'host', nullif(lower(CASE WHEN startswith(p.hostinfo, '[') THEN {bracketed} ELSE {plain} END), ''),"
            f" 'port', CASE WHEN {port} BETWEEN 1 AND 65535 THEN CAST({port} AS STRING) END,"
            " 'database', CASE WHEN p.path <> '' THEN ltrim('/', p.path) END,"
            f" 'user', CASE WHEN contains(p.netloc, '@') THEN {_cut('p.userinfo', '^([^:]*)')} END,"
            " 'ssl_mode', try_element_at(filter(p.pairs, x -> lower(x.k) IN ('sslmode', 'ssl')), -1).v)")
    return _let("p", url_parts_sql(url), body)


def stable_id(*fields: Column) -> Column:
    """First 16 hex digits of the digest over the lower-cased, '|'-joined fields (null as '')."""
    joined = F.concat_ws("|", *[F.coalesce(f, F.lit("")) for f in fields])
    return F.substring(F.sha2(F.lower(joined), 256), 1, 16)


# File kinds and the pattern of the lower-cased path for each. The first that fits counts, so kinds known by their
# folder or name stand before those known by their ending. A deployment adds rules of its own in front.
DETECTOR_RULES = (
    ("env_file", r"(^|/)\.env[^/]*$|\.env$"),
    ("docker_compose", r"docker-compose[^/]*$|(^|/)compose[^/]*$|/docker/"),
    ("ci", r"/\.github/workflows/"),
    ("k8s_manifest", r"/k8s/|/kubernetes/|helm|/manifests/"),
    ("terraform", r"\.tf$"),
    ("odoo_config", r"odoo.*\.conf$|odoo\.conf[^/]*$"),
    ("docs", r"\.md$"),
    ("prisma_schema", r"\.prisma$"),
    ("toml_config", r"\.toml$"),
    ("config", r"\.(json|yaml|yml|ini|cfg)$"),
)
# Path tags and the pattern of each.
PATH_TAGS = {"ci": r"/\.github/|/ci/", "local": "/dev|development|local", "odoo": "odoo", "prod": "/prod|production",
             "staging": "/staging|stage", "supabase": "supabase"}


def detector_for_path(path: Column, rules: tuple[tuple[str, str], ...] = DETECTOR_RULES) -> Column:
    """Kind of a file from its path."""
    p = F.lower(path)
    return F.coalesce(*[F.when(p.rlike(pattern), kind) for kind, pattern in rules], F.lit("code_or_text"))


def tags_for_path(path: Column, tags: dict[str, str] | None = None) -> Column:
    p = F.lower(path)
    return F.array_compact(F.array(*[F.when(p.rlike(pattern), F.lit(tag)) for tag, pattern in (tags or PATH_TAGS).items()]))
