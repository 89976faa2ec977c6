"""The shipped pipelines, put together from common steps."""

from __future__ import annotations


def step(op: str, **args) -> dict:
    """An operation with its arguments, as configurations have them."""
    return {"op": op, "args": args}


def _sub(pattern: str, repl: str) -> dict:
    return step("replace", pattern=pattern, repl=repl)


def _cut(pattern: str) -> dict:
    return step("split", pattern=pattern)


_BLANK = step("tokenize", name="RegexpTokenizer", kwargs=dict(pattern=r"\s+", gaps=True, discard_empty=True))
_STEM = step("stem", name="SnowballStemmer", kwargs=dict(language="english", ignore_stopwords=True))
_NUMBER = r"[0-9]+(?:\.[0-9]*)?"
_YEAR = r"\s+[0-9]{4}(?:'s\s|\s+)"
_LOOSE_QUOTES = _sub(r"'*\s+'*", " ")
_ANY_TWICE = _sub(r"(.)\1{2,}", r"\1\1")
_LETTERS_TWICE = _sub(r"([A-Za-z])\1{2,}", r"\1\1")
_SHORT = "[0-9]{1,2}"
#: dollar, pound, yen, and the block of currency signs
_MONEY = "$£¥₠-₾"

_COUNTS = [_sub(_YEAR, " _year_ "), _sub(_NUMBER, " _num_ "), _sub(r"_num_\s*?%", " _percent_ ")]
_MIDDLE = ["lower", *_COUNTS, _sub(r"\$\s*_num_", " _currency_ "), _LOOSE_QUOTES, _sub("[^A-Za-z_']", " "), _cut(r"\s+"), _ANY_TWICE]
_NEWS = [
    _sub("_", ""),
    _sub(r"[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+", " _email_ "),
    _sub("@[A-Za-z0-9_-]+", " _username_ "),
    _LETTERS_TWICE,
    "lower",
    _sub(r"(?:^|\s)(?:" + "|".join(sorted(["talk", "soc", "sci", "rec", "misc", "comp", "alt"])) + r")[^\sA-Aa-z0-9][a-z.-]+", " _group_ "),
    _sub(_NUMBER, " _num_ "),
    _LOOSE_QUOTES,
    _sub("[^A-Za-z_']", " "),
    _BLANK,
]
_SOCIAL = [
    _sub("\u00a0", " "),
    "lower",
    _LETTERS_TWICE,
    _sub("_", " "),
    _sub(r"[:;][-^]?\)", " _smiley_ "),
    _sub(r">?:[-^]?\(", " _frowny_ "),
    _sub(_NUMBER, " _num_ "),
    _sub(r"_num_\s*?%", " _percent_ "),
    _sub(r"\$\s*_num_", " _currency_ "),
    _sub(r"([$!?+*])\1+", r" _\1\1_ "),
    _sub(r"(?:[^_]|^)([$!?+*])(?:[^_]|$)", r" _\1_ "),
    _sub(r"[^\w'!?$+*]", " "),
    _BLANK,
    "stopwords",
    _STEM,
]
_TWITTER = [
    "lower",
    _sub(r"([A-Za-z]{2,}:(?:[0-9]{1,5})?/+)([0-9a-z]+\.)([0-9A-Za-z.]*)([\]\[/)('&%$#=*+:;,?!.~\w-]*)".replace(r"\w", "_0-9a-zA-Z"), r" <\1> \2\3 "),
    _sub(rf"{_SHORT}/{_SHORT}(?:/(?:[0-9]{{2}}|(?:1|2)[0-9]{{3}}))?", " <date> "),
    _sub(_YEAR, " <year> "),
    _sub(_NUMBER, " <num> "),
    _sub(r"_num_\s*?%", " <percent> "),
    _sub(f"([{_MONEY}])", r" <\1> "),
    _ANY_TWICE,
    step("tokenize", name="TweetTokenizer", kwargs=dict(strip_handles=True)),
    _sub(r'''["']*(.+)["']*''', r"\1"),
]
_WORLD_STOPS = step("stopwords", files=["english.stop", "spanish.stop", "french.stop", "arabic.stop"], words=["_num_", "_percent_"])
_WORLD_BASIC = [_sub(r"[^\w]", " "), _sub("[0-9]", "#"), _cut(r"\s+")]
_WORLD = ["lower", *_COUNTS, _sub(rf"([{_MONEY}])\s*_num_", r" _\1_ "), _LOOSE_QUOTES, _sub(rf"[^\w'{_MONEY}]+", " "), _cut(r"\s+"), _ANY_TWICE]


def _behind(*alternatives: str) -> str:
    return "".join(rf"(?<!\W{a})" for a in alternatives)


#: A full stop before a capital, unless a title or an initial stands before it.
_STOP = _behind("(?:[Pp]r(?:es|of)|[Cc]mdr)", "(?:[Rr]ev|[Mm]rs|[Hh]on|[Cc]ol|[SsGg]en)", "(?:[Ll][Tt]|[Dd][Rd])", "[Mm][SsRr]", "[A-Z]") + r"\.+\s*(?=[A-Z])"
_SENTENCES = [
    _sub(r"^(\S)", r" \1"),
    step("strip", chars="?!. \t\n"),
    _cut(_STOP),
    _cut(r"[!?]+\s*"),
    _cut(r"\.{2,}"),
    "strip",
    step("filter", pattern=".{0,3}", match="full"),
]

PIPELINES: dict[str, dict] = {
    "basic_unigrams": {
        "sequence": ["lower", _sub(_NUMBER, " NUM "), _LOOSE_QUOTES, _sub("[^A-Za-z']", " "), _BLANK, _ANY_TWICE, "stopwords", _STEM],
        "ngrams": {"n": 1, "max stopwords": 0}, "stopwords": "english",
    },
    "intermediate_unigrams": {"sequence": [*_MIDDLE, "stopwords"], "stopwords": "english"},
    "intermediate_unigrams_no_stopwords": {"sequence": _MIDDLE},
    "intermediate_unigrams+bigrams": {
        "sequence": _MIDDLE, "stopwords": "english",
        "ngrams": {"n": [1, 2], "max stopwords": 1, "proportion": 0.5, "join": True, "joinchar": "_", "end": "END"},
    },
    "20_newsgroups": {"sequence": _NEWS, "ngrams": {"n": [1], "max_stopwords": 0}, "stopwords": "english"},
    "no_punctuation_keep_stopwords": {"sequence": _NEWS, "ngrams": {"n": [1], "max_stopwords": 0}, "stopwords": "english"},
    "unigrams_social_media": {"sequence": _SOCIAL, "ngrams": {"n": 1, "max stopwords": 0}, "stopwords": "english"},
    "multilingual_twitter_unigrams_keep_stopwords": {"sequence": _TWITTER},
    "multilingual_unigrams_basic_keep_stopwords": {"sequence": _WORLD_BASIC},
    "multilingual_unigrams_basic_remove_stopwords": {"sequence": [*_WORLD_BASIC, _WORLD_STOPS]},
    "multilingual_unigrams_keep_stopwords": {"sequence": _WORLD},
    "multilingual_unigrams_remove_stopwords": {"sequence": [*_WORLD, _WORLD_STOPS]},
    "split_sentences": {"sequence": _SENTENCES},
}
