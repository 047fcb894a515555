"""Words of a text by a dictionary: the best path through all words that the text can be cut into."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Runs that the dictionary cuts, and runs that are words as they stand.
RUNS = re.compile("[一-龥]+|[A-Za-z0-9]+")
#: Entries of a dictionary that is sent to every worker; a larger one is refused.
MOST_WORDS = 1_000_000


class Lattice:
    """Words with how often they occur. A character that is no word counts as seen once."""

    def __init__(self, words: dict[str, int]) -> None:
        total = math.log(sum(words.values()) or 1)
        self.weight = {w: math.log(n) - total for w, n in words.items() if n > 0}
        self.single = -total
        self.longest = max(map(len, words), default=1)

    def cut(self, run: str) -> list[str]:
        """The words of a run that are likeliest together; of equal paths that whose first word is longest, and so on."""
        n = len(run)
        best, end = [0.0] * (n + 1), [n] * (n + 1)
        for i in range(n - 1, -1, -1):
            ways = [(self.weight.get(run[i : i + 1], self.single) + best[i + 1], i + 1)]
            ways += [(self.weight[run[i:j]] + best[j], j) for j in range(i + 2, min(n, i + self.longest) + 1) if run[i:j] in self.weight]
            best[i], end[i] = max(ways)
        out, i = [], 0
        while i < n:
            out.append(run[i : end[i]])
            i = end[i]
        return out

    def keywords(self, text: str | None) -> list[str]:
        """The different words of two characters or more, in order."""
        runs = RUNS.findall(text or "")
        words = [w for r in runs for w in (self.cut(r) if "一" <= r[0] <= "龥" else [r])]
        return list(dict.fromkeys(w for w in words if len(w) >= 2))


def tokeniser(words: dict[str, int]) -> Callable[[Column], Column]:
    """A function from text to its words, to stand for :func:`millrace.functions.rules.keywords` in the matcher.

    The dictionary goes to every worker once; its size is bounded.
    """
    if len(words) > MOST_WORDS:
        raise ValueError(f"a dictionary of {len(words)} words is too large to send to every worker")
    lattice = Lattice(words)

    def cut(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in texts:
            yield some.map(lattice.keywords)

    cut.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(cut, ArrayType(StringType()))


def dictionary(names: DataFrame, column: str, longest: int = 4, least: int = 2, most: int = MOST_WORDS) -> dict[str, int]:
    """A dictionary from names: runs of two to ``longest`` Chinese characters that occur ``least`` times or more, the commonest ``most`` of them."""
    runs = names.select(F.explode(F.regexp_extract_all(F.coalesce(column, F.lit("")), F.lit("([一-龥]{2,})"), 1)).alias("run"))
    pieces = lambda k: F.when(F.length("run") >= k, F.transform(F.sequence(F.lit(1), F.length("run") - k + 1), lambda i: F.substring("run", i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    counted = runs.select(F.explode(F.concat(*map(pieces, range(2, longest + 1)))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return {r.word: r.n for r in counted.orderBy(F.desc("n"), "word").limit(most).collect()}
