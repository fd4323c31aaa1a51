"""URL filters: a bit-parallel automaton of wildcard rules.

A rule is a glob for the host and one for the beginning of the path; it fits the host and all its subdomains. All rules become
one row of bits, a bit for each place in each rule, packed into 64-bit words. A URL is read once, code point by code point: a
shift moves every rule one place on, a mask keeps those whose next symbol is the one read (Shift-And), and a second mask keeps
the places where a star stands. The bits of the rules' ends then say which rules fit, and the longest of these decides.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import code_points, slices, table

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Ends a host: no code point, so no URL can say it.
HOST_END = 0x110000
#: Words of state that are moved at once, and steps after which the URLs whose rules are all decided are looked for.
AT_ONCE, DECIDED = 1 << 21, 32


class Rule(NamedTuple):
    """A host and the beginning of a path, in which * stands for any run and ? for one code point, and what the rule says."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))
#: Hosts that are blocked where no rule says otherwise.
BLOCKED = ("*spam*", "*casino*", "*pills*", "adult-*", "*porn*")
#: What is said where nothing fits.
DEFAULT = "allow"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (after the first :// up to /, ? or #, A-Z in lower case) and path (from there up to ? or #); empty where there is no ://."""
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*+", 0), CAPITALS, SMALL), F.regexp_extract(rest, r"^[^/?#]*+([^?#]*+)", 1)


class Automaton:
    """The rules as masks. Bit i of a rule is set while the first i of its symbols have been read."""

    def __init__(self, rules: list[tuple[str, str]]):
        symbols = [[(c, host) for host, glob in ((True, "*." + h), (False, p + "*")) for c in [*glob, *[HOST_END] * host]] for h, p in rules]
        self.letters = np.array(sorted({HOST_END, *(ord(c) for rule in symbols for c, _ in rule if c != HOST_END and c not in "*?")}), np.uint32)
        size = sum(sum(c != "*" for c, _ in rule) + 1 for rule in symbols)
        kinds, self.words = len(self.letters) + 1, max(1, -(-size // 64))
        step, stay, start = np.zeros((kinds, size), bool), np.zeros((kinds, size), bool), np.zeros(size, bool)
        ends, at = [], 0
        for rule in symbols:
            start[at] = True
            for c, host in rule:
                kind = slice(None) if c in ("*", "?") else int(np.searchsorted(self.letters, c if c == HOST_END else ord(c)))
                mask, place = (stay, at) if c == "*" else (step, at + 1)
                mask[kind, place] = True
                if host and c in ("*", "?"):  # a host's wildcards end with the host
                    mask[self._kind(HOST_END), place] = False
                at += c != "*"
            ends.append(at)
            at += 1
        self.ends = np.array(ends, np.int64)
        self.step, self.stay, self.start = (self._packed(x) for x in (step, stay, start[None]))
        over = np.ones(size, bool)
        over[self.ends] = False
        self.open = self._packed(over[None])

    def _kind(self, c: int) -> int:
        return int(np.searchsorted(self.letters, c))

    def _packed(self, bits: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(bits), 64 * self.words), np.uint8)
        wide[:, : bits.shape[1]] = bits
        return np.packbits(wide, axis=1, bitorder="little").view(np.uint64)

    def fits(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        """Which rules (columns) fit which URLs."""
        if not len(self.ends):
            return np.zeros((len(hosts), 0), bool)
        read, starts = code_points([f".{h}\0{p}" for h, p in zip(hosts, paths)])
        read = read.copy()
        read[starts[:-1] + 1 + np.fromiter(map(len, hosts), np.int64, len(hosts))] = HOST_END
        kind = np.searchsorted(self.letters, read)
        kind[self.letters[np.minimum(kind, len(self.letters) - 1)] != read] = len(self.letters)
        longest_first = np.argsort(starts[:-1] - starts[1:], kind="stable")
        begin, length = starts[:-1][longest_first], np.diff(starts)[longest_first]
        state = np.repeat(self.start, len(hosts), axis=0)
        left = np.searchsorted(-length, -np.arange(length.max(initial=0)), side="left")  # URLs that go on at each step
        for i, n in enumerate(left.tolist()):
            now, at = state[:n], kind[begin[:n] + i]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            moved &= self.step[at]
            now &= self.stay[at]
            now |= moved
            if i % DECIDED == DECIDED - 1 and not (now & self.open).any():
                break  # what is left stands at ends, which stay
        out = np.zeros((len(hosts), len(self.ends)), bool)
        out[longest_first] = state[:, self.ends // 64] >> (self.ends % 64).astype(np.uint64) & np.uint64(1) > 0
        return out


def judgement(host: Column, path: Column, rules: tuple[Rule, ...] = RULES, blocked: tuple[str, ...] = BLOCKED, default: str = DEFAULT) -> Column:
    """struct of rule (name of the longest rule that fits, the earlier of equally long ones; null if none does) and verdict (the
    rule's; else block for a blocked host, else the default)."""
    order = sorted(rules, key=lambda r: -len(r.name))
    names = pa.array([*(r.name for r in order), *[None] * (len(blocked) + 1)], pa.string())
    verdicts = pa.array([*(r.verdict for r in order), *["block"] * len(blocked), default], pa.string())
    globs = [*((r.host, r.path) for r in order), *((b, "") for b in blocked)]
    built: list[Automaton] = []

    def judged(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        automaton = built[0] if built else built.append(Automaton(globs)) or built[0]
        h, p = ([x or "" for x in column.to_pylist()] for column in (hosts, paths))
        found = [np.zeros(0, np.int64)]
        for a, b in slices([automaton.words] * len(h), AT_ONCE):
            fits = np.concatenate([automaton.fits(h[a:b], p[a:b]), np.ones((b - a, 1), bool)], axis=1)
            found.append(fits.argmax(axis=1))
        first = pa.array(np.concatenate(found))
        return pa.StructArray.from_arrays([names.take(first), verdicts.take(first)], names=["rule", "verdict"])

    return F.arrow_udf(judged, "rule string, verdict string")(host, path)


def judged(pages: DataFrame, rules: tuple[Rule, ...] = RULES, blocked: tuple[str, ...] = BLOCKED, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages (page_id, url), without a shuffle.

    A null url, one without :// and an empty one have neither host nor path: no rule fits, and the default is said. Rows that repeat, and
    null ids, are judged like any other; ties between rules of one length go to the earlier; other columns are ignored; very long urls
    are read as far as a rule is undecided; an empty table gives no rows.
    """
    host, path = parts(F.col("url").cast("string"))
    cut = pages.select("page_id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    said = cut.withColumn("said", judgement(F.col("host"), F.col("path"), rules, blocked, default))
    return said.select("page_id", "host", "path", "said.rule", "said.verdict")


def allowed(pages: DataFrame, rules: tuple[Rule, ...] = RULES, blocked: tuple[str, ...] = BLOCKED, default: str = DEFAULT) -> DataFrame:
    """The pages whose verdict is allow, whole rows with all their columns, whatever their names and types; else as in `judged`."""
    host, path = parts(F.col("url").cast("string"))
    said = judgement(F.coalesce(host, F.lit("")), F.coalesce(path, F.lit("")), rules, blocked, default)
    return pages.where(said["verdict"] == "allow")


def query(spark, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"))


SQL = f"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{CAPITALS}', '{SMALL}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(rule_host, rule_path, says) AS (VALUES {", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in RULES)}),
said AS (
  SELECT page_id, host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(says, length(rule_host || rule_path)) AS says
  FROM parts LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id, host, path)
SELECT page_id, host, path, rule,
  coalesce(says, CASE WHEN {" OR ".join(f"('.' || host) LIKE '%.{b.replace('*', '%')}'" for b in BLOCKED)} THEN 'block' ELSE '{DEFAULT}' END) AS verdict FROM said
"""
