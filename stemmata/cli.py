"""Command line: python -m stemmata.cli <command> --data <folder>. One command is one DataFrame."""

from __future__ import annotations

import argparse
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators.cases import rendered
from .plans import catalog
from .plans.views import Era
from .session import session
from .sources.load import load
from .sources.scratch import swept

#: Units of time columns, in microseconds.
MICROS, MINUTES, DAYS = 1, 60_000_000, 86_400_000_000
START = datetime(2024, 1, 1, tzinfo=timezone.utc)  # minute 0 of versions


@dataclass(frozen=True)
class Command:
    """A query, its time column with its unit, and what its time counts from (microseconds since the epoch)."""

    query: str
    at: str | None = None
    unit: int = MICROS
    zero: int = 0
    scans: bool = False  # reads documents alone, so a scan can be bounded in time


EPOCH = int(START.timestamp()) * 1_000_000
COMMANDS = {
    "windows": Command("q07_window_tiling", scans=True),
    "discover": Command("q23_belief_rollup_lead", scans=True),
    "alive": Command("q26_alive_trace", scans=True),
    "trail": Command("q33_trail_status", "first_held"),
    "lifecycle": Command("q29_returns", "gone_at", DAYS),
    "live": Command("q88_newest_matches"),
    "audit-sample": Command("q42_stratified_sample"),
    "audit-show": Command("q86_window_view"),
    "audit-sheet": Command("q87_shown_first"),
    "audit-models": Command("q43_confusion"),
    "audit-score": Command("q16_kappa_wilson"),
    "chance": Command("q79_chance_by_agent", scans=True),
    "population": Command("q80_population", scans=True),
    "holdings": Command("q73_holdings", "first_at", MINUTES, EPOCH, scans=True),
    "facts": Command("q48_era_facts", scans=True),
    "verify": Command("q93_trail_checks"),
    "score": Command("q89_known_case_scores"),
}


def moment(text: str) -> datetime:
    at = datetime.fromisoformat(text)
    return at if at.tzinfo else at.replace(tzinfo=timezone.utc)


def day_end(text: str) -> datetime:
    """A bare date means the whole day: its last microsecond."""
    at = moment(text)
    return at + timedelta(days=1) - timedelta(microseconds=1) if len(text) == 10 else at


def narrowed(df: DataFrame, command: Command, belief: str | None = None, agent: str | None = None, since: str | None = None, to: str | None = None) -> DataFrame:
    """The rows of one belief or agent, and those whose time lies within [since, to]; a filter that the rows don't have is an error."""
    for name, value in (("belief", belief), ("agent", agent)):
        if value is not None:
            if name not in df.columns:
                raise ValueError(f"these rows have no {name}; they have: {', '.join(df.columns)}")
            df = df.where(F.col(name).cast("string") == value)
    for text, read, op in ((since, moment, ">="), (to, day_end, "<=")):
        if text is not None:
            if command.at is None:
                raise ValueError("these rows have no time")
            micros = int(read(text).timestamp() * 1_000_000) - command.zero
            at = F.col(command.at) * command.unit
            df = df.where(at >= micros if op == ">=" else at <= micros)
    return df


def bounded(folder: str, since: str | None, to: str | None) -> str | Era:
    """The folder, or the part of its time that lies within [since, to]: a bound on the scan."""
    if since is None and to is None:
        return folder
    after = lambda at: int(at.timestamp() * 1_000_000) - EPOCH
    low = 0 if since is None else -(-after(moment(since)) // MINUTES)
    return Era(folder, low, 1 << 62 if to is None else after(day_end(to)) // MINUTES + 1)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="stemmata")
    sub = p.add_subparsers(dest="command", required=True)
    for name in COMMANDS:
        c = sub.add_parser(name)
        c.add_argument("--data", required=True, help="folder of Parquet tables")
        c.add_argument("--belief", help="rows of one belief")
        c.add_argument("--agent", help="rows of one agent")
        c.add_argument("--from", dest="since", help="first moment, ISO")
        c.add_argument("--to", help="last moment, ISO; a bare date is the whole day")
        c.add_argument("--rows", type=int, default=20, help="rows to show; --out writes all")
        c.add_argument("--out", help="folder to write the whole result to")
        if COMMANDS[name].scans:
            c.add_argument("--scan-from", help="first moment to read at all, ISO; versions are numbered from there")
            c.add_argument("--scan-to", help="last moment to read at all, ISO; a bare date is the whole day")
    c = sub.add_parser("sweep")
    c.add_argument("--hours", type=float, default=24, help="age of what is deleted from the shared folder")
    c = sub.add_parser("load")
    c.add_argument("--source", required=True)
    c.add_argument("--target", required=True)
    c.add_argument("--only", nargs="*")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = session()
    if a.command == "load":
        load(spark, a.source, a.target, a.only)
        return 0
    if a.command == "sweep":
        print(swept(spark, a.hours))
        return 0
    command = COMMANDS[a.command]
    if command.scans:
        a.data = bounded(a.data, a.scan_from, a.scan_to)
    df = narrowed(catalog.queries()[command.query](spark, a.data), command, a.belief, a.agent, a.since, a.to)
    if a.out:
        df.write.mode("overwrite").parquet(a.out)
    else:
        for row in rendered(df.limit(a.rows), df.columns[:1], df.columns).orderBy("place").collect():
            print(row["line"])
    if a.command == "verify":
        return int(not df.agg({"failed": "sum"}).first()[0] == 0)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
