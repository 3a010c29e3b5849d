"""URL filters: a bit-parallel wildcard automaton over canonical URLs.

All glob rules are packed into one multiword Shift-And machine: every pattern position is a bit, a
character advances all patterns at once (``((D << 1) & B[c])``), and ``*`` / ``**`` are self-loops
(``D & L[c]``).  A batch of URLs is simulated column by column, so one numpy step moves every pattern of
every URL.  Canonical form: ``"." + host + path``; hosts hold no ``/``, so the first ``/`` ends the host.

Globs: ``?`` one character, ``*`` a run without ``/``, ``**`` any run, all else literal.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER

_CELLS = 1 << 21  # characters simulated at once


@dataclass(frozen=True)
class GlobRule:
    """A glob over canonical URLs; of several that match, the highest priority (then the first) decides."""

    glob: str
    verdict: str
    label: str
    priority: int = 0


def host_rule(host: str, path: str, verdict: str) -> GlobRule:
    """A rule for a host with all its subdomains and a path start; longer rules take precedence."""
    def literal(s: str) -> str:
        if set(s) & set("*?"):
            raise ValueError(f"wildcards are not allowed in a host rule: {s!r}")
        return s

    label = literal(host) + literal(path)
    return GlobRule(f"*.{label}**", verdict, label, len(label))


class WildcardAutomaton:
    """Multiword Shift-And machine for a list of globs."""

    def __init__(self, globs: Sequence[str]):
        loops_any, loops_seg, start, accept, chars = [], [], [], [], {}
        at = 0
        for glob in globs:
            start.append(at)
            i = 0
            while i < len(glob):
                if glob.startswith("**", i):
                    loops_any.append(at)
                    i += 2
                elif glob[i] == "*":
                    loops_seg.append(at)
                    i += 1
                else:
                    at += 1
                    chars.setdefault(glob[i], []).append(at)
                    i += 1
            accept.append(at)
            at += 1
        self.words = max(1, -(-at // 64))
        any_char = self._mask(chars.pop("?", []))
        self.known = np.array(sorted({*map(ord, chars), ord("/")}), np.uint32)
        self.advance = np.stack([any_char] + [any_char | self._mask(chars.get(chr(c), [])) for c in self.known])
        every, segment = self._mask(loops_any), self._mask(loops_seg)
        self.loop = np.stack([every | (segment if c != ord("/") else 0) for c in (0, *self.known)])
        self.start, self.accept = self._mask(start), accept

    def _mask(self, bits: Sequence[int]) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for b in bits:
            out[b // 64] |= np.uint64(1 << (b % 64))
        return out

    def _run(self, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """codes: one row per text, longest first. The machines' state words after each text's last character."""
        at = np.searchsorted(self.known, codes)
        at[at == len(self.known)] = 0
        kind = np.where(self.known[at] == codes, at + 1, 0)
        state = np.tile(self.start, (len(codes), 1))
        for j in range(codes.shape[1]):
            live = int(np.searchsorted(-lengths, -j, "left"))  # texts longer than j
            d, k = state[:live], kind[:live, j]
            shifted = d << np.uint64(1)
            shifted[:, 1:] |= d[:, :-1] >> np.uint64(63)
            state[:live] = (shifted & self.advance[k]) | (d & self.loop[k])
        return state

    def first_match(self, texts: Sequence[str], order: Sequence[int]) -> np.ndarray:
        """For each text the first glob in order that matches it whole, else -1."""
        found = np.full(len(texts), -1, np.int64)
        raw = [t.encode("utf-32-le", "surrogatepass") for t in texts]
        lengths = np.array([len(r) // 4 for r in raw], np.int64)
        by_length = np.argsort(-lengths, kind="stable")
        i = 0
        while i < len(texts):
            width = int(lengths[by_length[i]])
            rows = by_length[i : i + max(1, _CELLS // max(1, width))]
            codes = np.zeros((len(rows), width), np.uint32)
            for r, k in enumerate(rows):
                codes[r, : lengths[k]] = np.frombuffer(raw[k], np.uint32)
            state = self._run(codes, lengths[rows])
            best = np.full(len(rows), -1, np.int64)
            for rule in reversed(order):
                bit = self.accept[rule]
                best[(state[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1) == 1] = rule
            found[rows] = best
            i += len(rows)
        return found


def filter_urls(pages: DataFrame, rules: Sequence[GlobRule], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Judge every URL by the rules; default is the verdict where no glob matches.

    Returns id_col, host, path, rule (label or null), verdict.  Null URLs and URLs without ``://`` have an
    empty host and path and get the default.  Repeated rows are judged alike, other columns are ignored;
    an empty table gives an empty result.  Narrow transformation: no shuffle; rules are a fixed parameter.
    """
    rules = list(rules)
    url = F.col(url_col)
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    parts = (
        pages.select(F.col(id_col), F.coalesce(rest, F.lit("")).alias("_rest"))
        .select(id_col, "_rest", F.regexp_extract("_rest", r"^[^/?#]*", 0).alias("_host"))
        .select(
            id_col,
            F.translate("_host", UPPER, LOWER).alias("host"),
            F.regexp_extract(F.expr("substring(_rest, length(_host) + 1)"), r"^[^?#]*", 0).alias("path"),
        )
    )
    order = sorted(range(len(rules)), key=lambda i: (-rules[i].priority, i))
    automaton = WildcardAutomaton([r.glob for r in rules])

    @F.pandas_udf("int")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for urls in batches:
            yield pd.Series(automaton.first_match(urls.tolist(), order), dtype="int32")

    if not rules:
        return parts.select(id_col, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    labels = F.array(*[F.lit(r.label) for r in rules])
    verdicts = F.array(*[F.lit(r.verdict) for r in rules])
    hit = parts.withColumn("_hit", judge(F.concat(F.lit("."), "host", "path")))
    return hit.select(
        id_col, "host", "path",
        F.when(F.col("_hit") >= 0, F.get(labels, F.col("_hit"))).alias("rule"),
        F.when(F.col("_hit") >= 0, F.get(verdicts, F.col("_hit"))).otherwise(default).alias("verdict"),
    )
