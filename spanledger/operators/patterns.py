"""Risk patterns, error signatures and the rating of whole command lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanledger.functions import text as T
from spanledger.functions import words as W

# Fixed values. Literal substrings of destructive commands with the lowest rating of a
# line that holds one.
DESTRUCTIVE = [
    ("dp-rm-rf", "rm -rf", "red"),
    ("dp-rm-rf-root", "rm -rf /", "red"),
    ("dp-wipefs", "wipefs", "red"),
    ("dp-lvremove", "lvremove", "red"),
    ("dp-pvcreate", "pvcreate", "red"),
    ("dp-vgcreate", "vgcreate", "red"),
    ("dp-vgremove", "vgremove", "red"),
    ("dp-mkfs", "mkfs", "red"),
    ("dp-userdel", "userdel", "red"),
    ("dp-dnf-remove", "dnf remove", "yellow"),
    ("dp-systemctl-disable-now", "systemctl disable --now", "yellow"),
    ("dp-yum-remove", "yum remove", "yellow"),
    ("dp-auditctl-delete-all", "auditctl -D", "yellow"),
    ("dp-chown-R", "chown -R", "red"),
    ("dp-kill-9", "kill -9", "red"),
]
RANK = {"green": 0, "yellow": 1, "red": 2}


def rank_of(rating: Column) -> Column:
    """-1 for anything unrated."""
    return F.when(rating == "green", 0).when(rating == "yellow", 1).when(rating == "red", 2).otherwise(-1)


def name_of(rank: Column) -> Column:
    return F.when(rank == 0, "green").when(rank == 1, "yellow").when(rank == 2, "red").otherwise("unrated")


def pattern_rank(text: Column, patterns=DESTRUCTIVE) -> Column:
    """Highest rank of the patterns found in a text or in it without its quotes; -1 if none.

    The patterns are a short curated list, so they become one expression inside the scan
    and nothing is joined.
    """
    low = F.lower(text)
    bare = F.translate(low, "\"'", "")
    hits = [F.when(low.contains(m.lower()) | bare.contains(m.lower()), RANK[r]).otherwise(-1)
            for _, m, r in patterns]
    return F.greatest(*hits, F.lit(-1))


def rate_by_pattern(df: DataFrame, text: str, declared: Column | None = None,
                    patterns=DESTRUCTIVE) -> DataFrame:
    """Adds ``rating``: the higher of the declared rating and the pattern's; never green by default."""
    rank = pattern_rank(F.col(text), patterns)
    if declared is not None:
        rank = F.greatest(rank, rank_of(declared))
    return df.withColumn("rating", name_of(rank))


def first_signature(text: Column, signatures: list[tuple[str, str]]) -> Column:
    """Id of the first signature, in list order, whose expression is found in the text."""
    expr = F.when(F.lit(False), "")
    for sig, pattern in signatures:
        expr = expr.when(text.rlike("(?i)" + pattern), sig)
    return expr.otherwise("")


def _under(path: Column, dirs: list[str]) -> Column:
    return path.rlike("^(?:" + "|".join(dirs) + r")(?:/|\z)")


def target_rank(path: Column) -> Column:
    """Rank of writing to a path: the null sink and scratch 0, system 2, other known roots 1, else -1."""
    return (F.when(path == "/dev/null", 0).when(_under(path, W.SYSTEM_DIRS), 2)
            .when(_under(path, W.SCRATCH_DIRS), 0).when(path.rlike("^/(srv|mnt|opt|var)(/|$)"), 1)
            .otherwise(-1))


# Programs that destroy what a pipe feeds them, and ratings of programs by name.
XARGS_DESTRUCTIVE = ["rm", "kill", "shred", "rmdir", "userdel"]


def command_risk(df: DataFrame, text: str, tool_ratings: dict[str, str]) -> DataFrame:
    """Adds ``risk`` of a multi-stage line.

    The highest of: its stages' program ratings, the places it writes to, a destructive
    program fed by xargs, and the destructive patterns over the whole line. A program or
    write target nobody has rated makes an otherwise green line unrated.
    """
    c = F.col(text)
    heads = T.stage_heads(c)
    by_name = F.create_map(*[x for k, v in tool_ratings.items() for x in (F.lit(k), F.lit(RANK[v]))])
    stage_ranks = F.transform(heads, lambda h: F.coalesce(F.try_element_at(by_name, h), F.lit(-1)))
    quiet = F.regexp_replace(c, T.QUOTED_RUN, "Q")
    targets = F.regexp_extract_all(quiet, F.lit(r"(?:[0-9]?>>?|\btee(?: -a)?)\s*([^\s|;&>]+)"), F.lit(1))
    target_ranks = F.transform(F.filter(targets, lambda t: ~t.rlike("^&?[0-9]$")), target_rank)
    fed = F.exists(T.stages(c), lambda s: T.first_token(s).isin("xargs")
                   & T.basename(T.command_head(s)).isin(XARGS_DESTRUCTIVE))
    worst = F.array_max(F.concat(stage_ranks, target_ranks, F.array(F.lit(-1))))
    unknown = F.exists(F.concat(stage_ranks, target_ranks), lambda r: r < 0) | (F.size(stage_ranks) == 0)
    rank = F.greatest(worst, pattern_rank(c), F.when(fed, 2).otherwise(-1))
    return df.withColumn("risk", F.when((rank <= 0) & unknown, "unrated").otherwise(name_of(rank)))


def changes_state(text: Column) -> Column:
    words = "|".join(W.STATE_CHANGE_WORDS)
    return text.rlike(rf"\b(?:{words})\b|{'|'.join(W.STATE_CHANGE_FLAGS)}")


def below_floor(df: DataFrame, text: str, rating: str) -> DataFrame:
    """Lines that change state while rated below yellow."""
    return df.where(changes_state(F.col(text)) & (rank_of(F.col(rating)) < 1))
