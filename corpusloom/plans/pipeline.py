"""Compilation of a specification to column expressions.

The state of a pipeline is a string until something splits it, and an array of
strings from then on; the same operation then works on each string.  All but
stemming stays in the JVM.  Empty strings are dropped at the end.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stem import stemmed
from . import regexlate
from .spec import Op, PipelineSpec, stop_list

#: Marks where a separator that is kept begins and ends.
MARK = "\ue000"
TWEET_TOKEN = (
    r"https?://\S+|[<>]?[:;=8][\-o*']?[)\](\[dDpP/:}{@|\\]|[)\](\[dDpP/:}{@|\\][\-o*']?[:;=8][<>]?|<3|<[^>\s]+>|-+>|<-+"
    r"|[\w.+-]+@[\w-]+\.[\w.-]*\w|@\w+|#+[\w'-]*\w|[^\W\d_](?:[^\W\d_]|['_-])+[^\W\d_]|[+-]?\d+[,/.:-]\d+[+-]?|\w+|\.(?:\s*\.)+|\S"
)
HANDLE = r"(?<![A-Za-z0-9_!@#$%&*])@[A-Za-z0-9_]{1,20}(?![A-Za-z0-9_]|@)"


@dataclass(frozen=True)
class State:
    value: Column
    is_array: bool

    def each(self, f: Callable[[Column], Column]) -> State:
        return State(F.transform(self.value, f) if self.is_array else f(self.value), self.is_array)

    def array(self) -> Column:
        return self.value if self.is_array else F.array(self.value)

    def split(self, f: Callable[[Column], Column]) -> State:
        return State(F.flatten(F.transform(self.value, f)) if self.is_array else f(self.value), True)


class Pipeline:
    """Columns of tokens from columns of text."""

    def __init__(self, spec: PipelineSpec | dict | str | Path):
        if isinstance(spec, dict):
            spec = PipelineSpec.read(spec)
        elif isinstance(spec, (str, Path)):
            spec = PipelineSpec.load(spec)
        self.spec = spec

    def stages(self, text: Column) -> list[State]:
        state, out = State(text, False), []
        for step in self.spec.steps:
            if isinstance(step, Op):
                state = getattr(self, "_" + step.name)(state, step.args)
            else:
                state = state.each(step)
            out.append(state)
        return out

    def tokens(self, text: Column) -> Column:
        """Array of non-empty strings; null for a null text."""
        steps = self.stages(text)
        value = (steps[-1] if steps else State(text, False)).array()
        return F.when(text.isNotNull(), F.filter(value, lambda x: x != ""))

    def debug(self, df: DataFrame, text: str = "text") -> DataFrame:
        """The rows with a column stage_k of strings after each step."""
        return df.select("*", *[s.array().alias(f"stage_{k}") for k, s in enumerate(self.stages(F.col(text)))])

    def ngrams(self, tokens: Column, n: int | None = None) -> Column:
        """The n-grams of all lengths of the specification, or of one."""
        from ..operators.ngrams import ngrams

        spec = self.spec.ngrams if n is None else replace(self.spec.ngrams, n=(n,))
        return ngrams(tokens, spec, self.spec.stopwords)

    @staticmethod
    def _replace(s: State, a: dict) -> State:
        p, r = regexlate.pattern(a["pattern"]), regexlate.replacement(a["repl"])
        return s.each(lambda x: F.regexp_replace(x, F.lit(p), F.lit(r)))

    @staticmethod
    def _split(s: State, a: dict) -> State:
        p = a["pattern"]
        keep = bool(a.get("keep"))
        n = regexlate.groups(p)
        if not keep and not n:
            java = regexlate.pattern(p)
            return s.split(lambda x: F.split(x, java, -1))
        # Java's split never gives groups: they are written into the text between marks
        java = regexlate.pattern(f"({p})" if keep else p)
        repl = MARK + MARK.join(f"${i}" for i in range(1, n + keep + 1)) + MARK
        return s.split(lambda x: F.split(F.regexp_replace(x, F.lit(java), F.lit(repl)), MARK, -1))

    @staticmethod
    def _strip(s: State, a: dict) -> State:
        chars = a.get("chars")
        if chars is not None:
            return s.each(lambda x: F.btrim(x, F.lit(chars)))
        edges = r"(?U)^[\s\x1c-\x1f\x85]+|[\s\x1c-\x1f\x85]+\z"
        return s.each(lambda x: F.regexp_replace(x, F.lit(edges), F.lit("")))

    @staticmethod
    def _test(a: dict, default: str = "full") -> Callable[[Column], Column]:
        p = a["pattern"]
        java = regexlate.full(p) if str(a.get("match", default)).lower() == "full" else regexlate.pattern(p)
        return lambda x: x.rlike(java)

    def _filter(self, s: State, a: dict) -> State:
        test = self._test(a)
        return State(F.filter(s.array(), lambda x: ~test(x)), True)

    def _retain(self, s: State, a: dict) -> State:
        return State(F.filter(s.array(), self._test(a)), True)

    def _cased(self, s: State, a: dict, f: Callable[[Column], Column]) -> State:
        if not a.get("pattern"):
            return s.each(f)
        test = self._test(a)
        if a.get("exclude"):
            return s.each(lambda x: F.when(test(x), x).otherwise(f(x)))
        return s.each(lambda x: F.when(test(x), f(x)).otherwise(x))

    def _lower(self, s: State, a: dict) -> State:
        return self._cased(s, a, F.lower)

    def _upper(self, s: State, a: dict) -> State:
        return self._cased(s, a, F.upper)

    def _stopwords(self, s: State, a: dict) -> State:
        words = sorted(set(self.spec.stopwords) | set(a.get("words", ())))
        return State(F.filter(s.array(), lambda x: ~x.isin(words)), True) if words else s

    def _tokenize(self, s: State, a: dict) -> State:
        given = {**(self.spec.tokenizer or {}), **a}
        name, k = given.get("name", "WhitespaceTokenizer"), given.get("kwargs") or {}
        if name == "RegexpTokenizer":
            java = regexlate.pattern(k["pattern"])
            if k.get("gaps"):
                out = s.split(lambda x: F.split(x, java, -1))
                return State(F.filter(out.value, lambda x: x != ""), True) if k.get("discard_empty", True) else out
            return s.split(lambda x: F.regexp_extract_all(x, F.lit(java), F.lit(0)))
        if name == "WhitespaceTokenizer":
            out = s.split(lambda x: F.split(x, regexlate.pattern(r"\s+"), -1))
            return State(F.filter(out.value, lambda x: x != ""), True)
        if name == "WordPunctTokenizer":
            return s.split(lambda x: F.regexp_extract_all(x, F.lit(regexlate.pattern(r"\w+|[^\w\s]+")), F.lit(0)))
        if name == "TweetTokenizer":
            if k.get("strip_handles"):
                s = s.each(lambda x: F.regexp_replace(x, F.lit(regexlate.pattern(HANDLE)), F.lit(" ")))
            if k.get("reduce_len"):
                s = s.each(lambda x: F.regexp_replace(x, F.lit(regexlate.pattern(r"(.)\1{2,}")), F.lit("$1$1$1")))
            if k.get("preserve_case") is False:
                s = s.each(F.lower)
            return s.split(lambda x: F.regexp_extract_all(x, F.lit(regexlate.pattern(TWEET_TOKEN)), F.lit(0)))
        raise ValueError(f"unknown tokenizer {name!r}")

    def _stem(self, s: State, a: dict) -> State:
        given = {**(self.spec.stemmer or {}), **a}
        k = given.get("kwargs") or {}
        if given.get("name", "SnowballStemmer") not in ("SnowballStemmer", "Porter2") or k.get("language", "english") != "english":
            raise ValueError("the stemmer is SnowballStemmer, language english")
        return State(stemmed(s.array(), stop_list("english") if k.get("ignore_stopwords") else ()), True)
