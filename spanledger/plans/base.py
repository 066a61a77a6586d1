"""The registry of named queries, the tables they read, and shared SQL pieces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanledger.operators.lines import explode_lines
from spanledger.operators.support import computed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


TEXT_KEYS = {"documents": "doc_id", "conversations": "conv_id", "pages": "page_id", "events": "event_id",
             "orders": "o_orderkey", "part": "p_partkey"}


def texts(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A text table, its rows dealt by key: a file of few row groups would be worked on by as few tasks. The partitions
    are those of a shuffle, or as many as ``spark.spanledger.spread`` names."""
    parts = int(spark.conf.get("spark.spanledger.spread", spark.conf.get("spark.sql.shuffle.partitions")))
    return table(spark, sf, name).repartition(parts, TEXT_KEYS[name])


def document_lines(spark: SparkSession, sf: str) -> DataFrame:
    return explode_lines(texts(spark, sf, "documents"), "text", "doc_id", "lang", "source")


DOC_LINES = """
select doc_id, lang, source, cast(i as bigint) as line_no, ls[i] as line from (
  select doc_id, lang, source, ls, unnest(range(1, len(ls) + 1)) as i
  from (select *, string_split(text, chr(10)) as ls from documents))
"""

# Trimming and tokens as the library defines them, in DuckDB terms.
WS = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"


def sql_strip(c: str) -> str:
    return f"trim({c}, {WS})"


SQL_TOKEN = r"""(?:"[^"]*(?:"|\z)|''[^'']*(?:''|\z)|[^\s"'']+)+"""


def sql_tokens(c: str) -> str:
    return f"regexp_extract_all({c}, '{SQL_TOKEN}')"


def sql_list(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


# A command log derived from the events, one line each. The expression is plain SQL that
# both engines read; k comes from the event's properties, u is its user.
LOG_LINE = """case k % 20
 when 0 then concat('$ sudo -u svc', u, ' dnf install --yes pkg-', k)
 when 1 then concat('# systemctl enable --now app-', u % 7)
 when 2 then concat('$ cat /var/log/app-', u, '.log | grep -c error > /tmp/out-', k, '.txt')
 when 3 then concat('# timeout 5 rsync -a /srv/data /etc/app-', u)
 when 4 then concat('The user ', u, ' must be able to sign in and it is not an option.')
 when 5 then concat('$ echo "run ', k, '; now" >> /etc/motd && nohup tar -xf /home/u.tar')
 when 6 then concat('  # find /var/tmp -name core.', k, ' | xargs -n 1 rm -f')
 when 7 then concat('retry_limit = ', k)
 when 8 then concat('-w /etc/passwd -p wa -k user', u)
 when 9 then '# options {'
 when 10 then concat('Select Network ', k, ' from the menu and press Enter.')
 when 11 then concat('# APP_MODE=', k, ' gsettings list')
 when 12 then concat('# bash -c "rm -rf /srv/', u, '"')
 when 13 then '# for f in 1 2; do echo $f; done'
 when 14 then concat('$ ls -l $(which app-', u, ' | head -1) ; df || true 2>&1')
 when 15 then concat('# keep values ', k)
 when 16 then concat('$ podman run --name c', k, ' --template')
 when 17 then concat('#useradd -m user', u)
 when 18 then concat('## banner ', k)
 else concat('12:04:', k, ' host-', u, ' unit[9]: started') end"""


def command_log(spark: SparkSession, sf: str) -> DataFrame:
    """(event_id, user_id, release, ts, line): the log lines the events stand for."""
    e = texts(spark, sf, "events").select(
        "event_id", "user_id", "ts", F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.col("user_id").alias("u"))
    return computed(e, {"release": F.expr("cast(7 + u % 4 as string)"), "line": F.expr(LOG_LINE)}).drop("k", "u")


LOG = f"""
select event_id, user_id, ts, cast(7 + u % 4 as varchar) as release, {LOG_LINE} as line
from (select *, user_id as u, cast(json_extract_string(props, '$.k') as int) as k from events)
"""

# Prompt and command of a log line, in DuckDB terms.
LOG_COMMANDS = f"""
select *, case when regexp_matches(s, '^[$#][ \\t]+\\S') then s[1]
               when regexp_matches(s, '^#[A-Za-z0-9_/]') then '#' else '' end as prompt,
  case when regexp_matches(s, '^[$#][ \\t]+\\S') then trim(s[2:])
       when regexp_matches(s, '^#[A-Za-z0-9_/]') then s[2:] else '' end as command
from (select *, trim(line) as s from ({LOG}))
"""
