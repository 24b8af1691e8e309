"""Routing by intent and a cascade of tiers, built as one projection over a frame of pairs.

A tier that runs in Python sees only the rows that earlier tiers left undecided: its inputs are NULL elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.cleaning import Cleaner
from kindred.plans import algorithms as A
from kindred.plans.algorithms import Algorithm, Intent

RESULT = "struct<score:double,tier:int,algorithm:string,fallback_called:boolean,fallback_data:string>"
HOOK = "struct<score:double,data:string>"


@dataclass(frozen=True)
class Threshold:
    """greater_than and less_than are strict, between takes both ends."""

    kind: str
    low: float
    high: float | None = None

    def __post_init__(self) -> None:
        if self.kind not in ("greater_than", "less_than", "between"):
            raise ValueError(f"unknown threshold {self.kind!r}")
        if (self.kind == "between") != (self.high is not None):
            raise ValueError("between takes two values, the others one")

    @staticmethod
    def of(op: str | Threshold, *values: float) -> Threshold:
        if isinstance(op, Threshold):
            return op
        return Threshold({"gt": "greater_than", "lt": "less_than"}.get(op, op), *values)

    def holds(self, score: Column) -> Column:
        test = score > self.low if self.kind == "greater_than" else score < self.low if self.kind == "less_than" else score.between(self.low, self.high)
        return F.coalesce(test, F.lit(False))


def greater_than(x: float) -> Threshold:
    return Threshold("greater_than", x)


def less_than(x: float) -> Threshold:
    return Threshold("less_than", x)


def between(low: float, high: float) -> Threshold:
    return Threshold("between", low, high)


Hook = Callable[[str, str], tuple[float, str | None]]


def hook_udf(hook: Hook) -> Callable[[Column, Column], Column]:
    """A user's row function as a UDF that skips NULL rows; not deterministic, so it is never planned twice.

    A task that is retried calls the hook again for its rows.
    """

    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = [(None, None) if x is None or y is None else hook(x, y) for x, y in zip(a, b)]
        return pd.DataFrame({"score": pd.Series([r[0] for r in out], dtype="float64"), "data": pd.Series([r[1] for r in out], dtype=object)})

    return F.pandas_udf(run, HOOK).asNondeterministic()


def _settled(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that later expressions refer to as such: a generator of one row keeps projections from being merged.

    Merged, a cleaned text would be cleaned again wherever a score mentions it, once per n-gram for instance.
    """
    made = df.withColumns({f"{name}_": c for name, c in columns.items()})
    return made.select("*", F.inline(F.array(F.struct(*[F.col(f"{name}_").alias(name) for name in columns])))).drop(*[f"{name}_" for name in columns])


_INTENT_BOUNDS = {"names": (0.95, 0.10), "typos": (0.95, 0.10), "codes": (0.95, 0.10), "documents": (0.90, 0.05), "dedup": (0.90, 0.10), "auto": (0.95, 0.10)}


@dataclass(frozen=True)
class Flow:
    """Builder of a comparison; every method returns a changed copy.

    on_error: what a tier-1 or tier-2 Hamming on unequal lengths, or a pair that no tier decides, does: "raise" or "null".
    """

    cleaner: Cleaner | None = Cleaner()
    first: tuple[Algorithm, Threshold, Threshold] | None = None
    second: tuple[Algorithm, Threshold] | None = None
    hook: Callable[[Column, Column], Column] | None = None
    per_pair: bool = False
    strategy: str = "cascade"
    on_error: str = "raise"

    @staticmethod
    def for_intent(intent: str | Intent) -> Flow:
        """One tier of the intent's algorithm."""
        intent = Intent.of(intent)
        match, mismatch = _INTENT_BOUNDS[intent.value]
        return Flow().tier_1(A.resolve(intent), greater_than(match), less_than(mismatch))

    @staticmethod
    def auto() -> Flow:
        """The algorithm of each pair by its lengths; tiers that are set later are not used."""
        return Flow(per_pair=True)

    def preprocess(self, on: bool = True) -> Flow:
        """On: the default cleaning, in place of any other; off: none."""
        return replace(self, cleaner=Cleaner() if on else None)

    def with_preprocessor(self, cleaner: Cleaner) -> Flow:
        return replace(self, cleaner=cleaner)

    def with_strategy(self, name: str) -> Flow:
        if name != "cascade":
            raise ValueError(f"unknown strategy {name!r}")
        return replace(self, strategy=name)

    def tier_1(self, algorithm: str | Algorithm, match: Threshold, mismatch: Threshold) -> Flow:
        """Decides above match if that is a greater_than, or below mismatch if that is a less_than; other kinds decide nothing."""
        return replace(self, first=(A.by_name(algorithm), match, mismatch))

    def tier_2(self, algorithm: str | Algorithm, accept: Threshold) -> Flow:
        return replace(self, second=(A.by_name(algorithm), accept))

    def fallback(self, hook: Hook) -> Flow:
        """Tier 3: hook(a, b) gives (score, data); it gets the cleaned texts."""
        return replace(self, hook=hook_udf(hook))

    def fallback_udf(self, udf: Callable[[Column, Column], Column]) -> Flow:
        """Tier 3 as a UDF that returns struct<score double, data string>."""
        return replace(self, hook=udf)

    def errors(self, mode: str) -> Flow:
        if mode not in ("raise", "null"):
            raise ValueError("errors are 'raise' or 'null'")
        return replace(self, on_error=mode)

    # -- plans

    def compare(self, df: DataFrame, a: str = "a", b: str = "b", result: str = "result") -> DataFrame:
        """df with a result struct; NULL texts give a NULL result."""
        if self.per_pair:
            return self._auto(df, a, b, result)
        if self.first is None and self.second is None and self.hook is None:
            raise ValueError("no tiers configured")
        df, x, y = self._cleaned(df, a, b)
        null = F.lit(None).cast(RESULT)
        there = x.isNotNull() & y.isNotNull()
        steps: list[tuple[Column, Column]] = []
        names = ["_s1", "_d1", "_s2", "_d2", "_h", "_p1", "_q1", "_p2", "_q2"]
        open_ = there
        if self.first:
            algorithm, match, mismatch = self.first
            df, score = self._prepared(df, algorithm, x, y, 1)
            df = _settled(df, _s1=score)
            decided = F.lit(False)
            if match.kind == "greater_than":
                decided = decided | match.holds(F.col("_s1"))
            if mismatch.kind == "less_than":
                decided = decided | mismatch.holds(F.col("_s1"))
            df = df.withColumn("_d1", decided)
            steps.append((F.col("_d1"), _result(F.col("_s1"), 1, algorithm.name)))
            open_ = open_ & ~F.col("_d1")
        if self.second:
            algorithm, accept = self.second
            df, score = self._prepared(df, algorithm, F.when(open_, x), F.when(open_, y), 2)
            df = _settled(df, _s2=score)
            df = df.withColumn("_d2", accept.holds(F.col("_s2")))
            steps.append((F.col("_d2"), _result(F.col("_s2"), 2, algorithm.name)))
            open_ = open_ & ~F.col("_d2")
        if self.hook:
            df = _settled(df, _h=self.hook(F.when(open_, x), F.when(open_, y)))
            last = _result(F.col("_h.score"), 3, "fallback", True, F.col("_h.data"))
        elif self.first:
            last = _result(F.col("_s1"), 1, self.first[0].name)
            last = F.when(F.col("_s1").isNotNull(), last)
        else:
            last = F.raise_error(F.lit("no tiers configured: the second tier does not accept this pair")).cast(RESULT) if self.on_error == "raise" else null
        chain = F.when(~there, null)
        for test, value in steps:
            chain = chain.when(test, value)
        return df.withColumn(result, chain.otherwise(last)).drop("_x", "_y", *names)

    def compare_with_intent(self, df: DataFrame, intent: str | Intent, a: str = "a", b: str = "b", result: str = "result") -> DataFrame:
        """The intent's algorithm on the cleaned texts, past all tiers: tier 0."""
        intent = Intent.of(intent)
        if intent is Intent.AUTO:
            return self._auto(df, a, b, result)
        algorithm = A.resolve(intent)
        df, x, y = self._cleaned(df, a, b)
        df, score = self._prepared(df, algorithm, x, y, 1)
        df = _settled(df, _s1=score)
        return df.withColumn(result, F.when(F.col("_s1").isNotNull(), _result(F.col("_s1"), 0, algorithm.name))).drop("_x", "_y", "_s1", "_p1", "_q1")

    def _cleaned(self, df: DataFrame, a: str, b: str) -> tuple[DataFrame, Column, Column]:
        made = self.cleaner.apply if self.cleaner else (lambda c: c)
        return _settled(df, _x=made(F.col(a)), _y=made(F.col(b))), F.col("_x"), F.col("_y")

    def _prepared(self, df: DataFrame, algorithm: Algorithm, x: Column, y: Column, tier: int) -> tuple[DataFrame, Column]:
        """df with both sides prepared in columns of their own, so that a score refers to them as often as it likes, and the score."""
        names = f"_p{tier}", f"_q{tier}"
        if algorithm is A.HAMMING:
            return df, self._score(algorithm, x, y)
        return _settled(df, **dict(zip(names, (algorithm.prepare(x), algorithm.prepare(y))))), algorithm.compare(*map(F.col, names))

    def _score(self, algorithm: Algorithm, x: Column, y: Column) -> Column:
        score = algorithm.score(x, y)
        if algorithm is A.HAMMING and self.on_error == "raise":
            unequal = F.char_length(x) != F.char_length(y)
            score = F.when(unequal, F.raise_error(F.lit("hamming needs texts of equal length")).cast("double")).otherwise(score)
        return score

    def _auto(self, df: DataFrame, a: str, b: str, result: str) -> DataFrame:
        df, x, y = self._cleaned(df, a, b)
        df = _settled(df, _choice=A.auto_choice(x, y))
        choice = F.col("_choice")
        score: Column | None = None
        for algorithm in (A.HAMMING, A.JARO_WINKLER, A.BM25, A.simhash()):
            mine = choice == algorithm.name
            own = self._score(algorithm, F.when(mine, x), F.when(mine, y))
            score = F.when(mine, own) if score is None else score.when(mine, own)
        df = _settled(df, _s1=score)
        return df.withColumn(result, F.when(F.col("_s1").isNotNull(), _result(F.col("_s1"), 0, choice))).drop("_x", "_y", "_s1", "_choice")


def _result(score: Column, tier: int, algorithm: str | Column, called: bool = False, data: Column | None = None) -> Column:
    name = F.lit(algorithm) if isinstance(algorithm, str) else algorithm
    fields = (score.alias("score"), F.lit(tier).alias("tier"), name.alias("algorithm"), F.lit(called).alias("fallback_called"), (F.lit(None).cast("string") if data is None else data).alias("fallback_data"))
    return F.struct(*fields).cast(RESULT)
