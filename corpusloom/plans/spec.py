"""Pipeline specifications: read from YAML, JSON or dicts, with the many names that keys may have made one.

Configurations in Python files are refused: reading one would run it.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, replace
from functools import lru_cache
from pathlib import Path

from . import shipped

STOP_DIR = Path(__file__).with_name("stoplists")

_OPS = {
    "replace": "replace substitute sub",
    "split": "split splitter",
    "strip": "strip trim",
    "filter": "filter remove drop",
    "retain": "retain keep",
    "lower": "lower lowercase",
    "upper": "upper uppercase",
    "stopwords": "stopwords removestopwords filterstopwords",
    "tokenize": "tokenize tokenizer tokenise",
    "stem": "stem stemmer",
}
_KEYS = {
    "op": "op operation function func name",
    "args": "args arguments params parameters",
}
_ARGS = {
    "pattern": "pattern regex regexp expression",
    "repl": "repl replacement replace sub substitute",
    "keep": "keep keepseparators",
    "chars": "chars characters",
    "match": "match matchtype",
    "exclude": "exclude invert",
    "files": "files file",
    "words": "words word",
    "name": "name class",
    "kwargs": "kwargs keywordargs options",
}
_GLOBALS = {
    "sequence": "sequence operations ops steps pipeline",
    "ngrams": "ngrams ngram ngramconfig",
    "stopwords": "stopwords stops stoplist",
    "stemmer": "stemmer stem",
    "tokenizer": "tokenizer tokenize",
}
_NGRAMS = {
    "n": "n lengths length sizes",
    "maxstopwords": "maxstopwords maxstops",
    "proportion": "maxstopwordproportion proportion stopwordproportion",
    "join": "join joined",
    "joinchar": "joinchar joincharacter joiner",
    "start": "start begin starttoken",
    "end": "end endtoken",
    "stemngrams": "stemngrams stem",
}


def plain(key: str) -> str:
    """Lower case, without hyphens, underscores and white space."""
    return re.sub(r"[-_\s]", "", str(key)).lower()


def canonical(key: str, thesaurus: dict[str, str]) -> str:
    k = plain(key)
    hits = [name for name, words in thesaurus.items() if k == name or k in words.split()]
    if len(hits) != 1:
        raise ValueError(f"unknown name {key!r}" if not hits else f"name {key!r} has several meanings")
    return hits[0]


def cleaned(given: dict | None, thesaurus: dict[str, str]) -> dict:
    out: dict = {}
    for k, v in (given or {}).items():
        name = canonical(k, thesaurus)
        if name in out:
            raise ValueError(f"{name!r} is given twice")
        out[name] = v
    return out


def read_config(path: str | Path) -> dict:
    """A dict from a .yml, .yaml or .json file."""
    path = Path(path)
    if path.suffix in (".yml", ".yaml"):
        import yaml

        return yaml.safe_load(path.read_text(encoding="utf-8"))
    if path.suffix == ".json":
        return json.loads(path.read_text(encoding="utf-8"))
    raise ValueError(f"configurations are .yml, .yaml or .json files, not {path.suffix!r}")


def read_config_dir(folder: str | Path, extensions: tuple[str, ...] = (".yml", ".yaml", ".json")) -> dict[str, dict]:
    """{file name without extension: configuration} of a folder's files."""
    return {p.stem: read_config(p) for p in sorted(Path(folder).iterdir()) if p.suffix in extensions}


@lru_cache(maxsize=32)
def stop_list(name: str) -> tuple[str, ...]:
    """A shipped stop list: english, spanish, french or arabic."""
    words = (STOP_DIR / f"{Path(name).stem}.txt").read_text(encoding="utf-8").split()
    return tuple(dict.fromkeys(words))


def load_stopwords(files: list[str] | str | None = None, words: list[str] | None = None, base: str | Path | None = None) -> tuple[str, ...]:
    """Union of words and of files: text with a word a line, YAML or JSON lists, or the name of a shipped list; relative paths start at ``base``."""
    out = list(words or [])
    for f in [files] if isinstance(files, str) else files or []:
        p = Path(f) if Path(f).is_absolute() or base is None else Path(base, f)
        if base is not None and not p.exists() and p.with_suffix(".stop").exists():
            p = p.with_suffix(".stop")
        if not p.exists() and (STOP_DIR / f"{Path(f).stem}.txt").exists():
            out += stop_list(f)
        elif p.suffix in (".yml", ".yaml", ".json"):
            out += list(read_config(p))
        else:
            out += [line.strip() for line in p.read_text(encoding="utf-8").splitlines()]
    return tuple(w for w in dict.fromkeys(out) if w)


@dataclass(frozen=True)
class NgramSpec:
    n: tuple[int, ...] = (1,)
    max_stopwords: int | None = None
    proportion: float | None = None
    join: str | None = " "
    start: str | None = None
    end: str | None = None
    stem: bool = False

    @staticmethod
    def read(given: dict | None) -> NgramSpec:
        g = cleaned(given, _NGRAMS)
        n = g.get("n", [1])
        join = g.get("join", True)
        return NgramSpec(
            tuple([n] if isinstance(n, int) else n), g.get("maxstopwords"), g.get("proportion"),
            None if join is False else g.get("joinchar", " "), g.get("start"), g.get("end"), bool(g.get("stemngrams", False)),
        )


@dataclass(frozen=True)
class Op:
    name: str
    args: dict = field(default_factory=dict)


_NEEDS = {"replace": ("pattern", "repl"), "split": ("pattern",), "filter": ("pattern",), "retain": ("pattern",)}


@dataclass(frozen=True)
class PipelineSpec:
    """Steps in order, and what holds for all of them. Immutable; ``+``, `prepend` and `append` give new ones."""

    steps: tuple = ()
    ngrams: NgramSpec = NgramSpec()
    stopwords: tuple[str, ...] = ()
    stemmer: dict | None = None
    tokenizer: dict | None = None

    @staticmethod
    def read(given: dict, base: str | Path | None = None, stopwords: tuple[str, ...] | None = None) -> PipelineSpec:
        g = cleaned(given, _GLOBALS)
        if "sequence" not in g:
            raise ValueError("a pipeline needs a sequence of operations")
        steps = []
        for step in g["sequence"]:
            s = cleaned({"op": step} if isinstance(step, str) else step, _KEYS)
            name, args = canonical(s["op"], _OPS), cleaned(s.get("args"), _ARGS)
            missing = [k for k in _NEEDS.get(name, ()) if k not in args]
            if missing:
                raise ValueError(f"{name} needs {', '.join(missing)}")
            if name == "stopwords" and args:
                args = {"words": load_stopwords(args.get("files"), args.get("words"), base)}
            steps.append(Op(name, args))
        stops = g.get("stopwords")
        if stopwords is not None:
            words = tuple(stopwords)
        elif isinstance(stops, str):
            words = load_stopwords([stops], None, base)
        elif isinstance(stops, dict):
            d = cleaned(stops, {k: _ARGS[k] for k in ("files", "words")})
            words = load_stopwords(d.get("files"), d.get("words"), base)
        else:
            words = tuple(stops or ())
        return PipelineSpec(tuple(steps), NgramSpec.read(g.get("ngrams")), words, g.get("stemmer"), g.get("tokenizer"))

    @staticmethod
    def load(path: str | Path) -> PipelineSpec:
        return PipelineSpec.read(read_config(path), Path(path).parent)

    def prepend(self, *steps) -> PipelineSpec:
        """Steps may be `Op` or any function from Column to Column."""
        return replace(self, steps=(*steps, *self.steps))

    def append(self, *steps) -> PipelineSpec:
        return replace(self, steps=(*self.steps, *steps))

    def __add__(self, other: PipelineSpec) -> PipelineSpec:
        """These steps, then the other's; the other's settings stand where it has any."""
        return PipelineSpec(
            self.steps + other.steps, other.ngrams if other.ngrams != NgramSpec() else self.ngrams,
            tuple(dict.fromkeys(self.stopwords + other.stopwords)), other.stemmer or self.stemmer, other.tokenizer or self.tokenizer,
        )


def builtin_names() -> list[str]:
    return sorted(shipped.PIPELINES)


def builtin(name: str, stop_dir: str | Path | None = None) -> PipelineSpec:
    """A shipped pipeline by its name; with ``stop_dir`` its stop lists are read from that folder's files (english.stop and so on) in place of this package's own."""
    return PipelineSpec.read(shipped.PIPELINES[name], stop_dir)
