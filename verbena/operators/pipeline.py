"""The text pipeline: clean, annotate tokens, mask, filter, and put the text together again.

Everything is a projection of Column expressions: nothing is shuffled, and the same pipeline works on a
stream. No Python runs, but for cleaning by a lexicon of over 64 words (``functions.text.lookup``). Annotating and selecting are separate, so a changed configuration needs
no new annotation. The default annotator is a set of rules; one with a language model can be passed.
"""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, fields, replace
from functools import reduce
from operator import or_
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import NotFitted
from ..functions import lexicons
from ..functions.text import Lexicons, clean
from ..functions.vectors import let

MASKS = ("email", "url", "phone_number", "number", "proper_noun")


@dataclass(frozen=True)
class Config:
    """The actions; True filters or cleans, a string (for the five masks) replaces the token by it."""

    appos: bool = False
    slang: bool = False
    emoticons: bool = False
    emoticons_del: bool = False
    repeated_chars: bool = False
    sep_digit_text: bool = False
    eol_remove: bool = False
    eol_replace: bool = False
    html: bool = False
    punct: bool = False
    extra_space: bool = False
    email: bool | str = False
    url: bool | str = False
    stop_words: bool = False
    proper_noun: bool | str = False
    phone_number: bool | str = False
    number: bool | str = False
    single_char: bool = False
    lemmas: bool = False

    @classmethod
    def of(cls, given: dict | Config | None) -> Config:
        """From a dict; unknown keys are ignored, missing ones are off."""
        if isinstance(given, Config):
            return given
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in (given or {}).items() if k in known})


class Annotator(Protocol):
    def annotate(self, text: Column, fields: set[str] | None = None) -> Column:
        """ARRAY<STRUCT> of tokens with the fields of ``RuleAnnotator``, or with those that are asked for."""


#: In this order: e-mail, URL, number, contraction ends, words, white space beyond one space, any other character.
#: Before them, what is a word by all of them: ASCII letters before a blank or a mark that none of them goes on with (``cannot`` is two).
_TOKEN = (
    r"(?!(?i:cannot)\b)[A-Za-z]++(?=[ \n\r\t,;!?()\"]|\.(?:[ \n\r\t]|\z)|\z)"
    r"|[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+"
    r"|(?:https?://|www\.)[^\s<>\"]*[^\s<>\".,;:!?)']"
    r"|\p{Nd}+(?:[.,]\p{Nd}+)*(?![\p{L}_])"
    r"|(?<=[\p{L}])(?i:'(?:s|ve|re|ll|d|m))(?![\p{L}])"
    r"|(?i:can(?=not\b))|(?<=(?i:can))not\b"
    r"|[\p{L}\p{M}]+?(?=(?i:n't)\b)|(?i:n't)\b"
    r"|[\p{L}\p{M}\p{N}_]+"
    r"|(?<=\S )\s+|(?<=\S)(?! )\s+|^\s+"
    r"|[^\s]"
)

_PLAIN = re.compile("[a-z]+")
#: The ASCII characters of punctuation.
_MARKS = tuple("!\"#%&'()*,-./:;?@[\\]_{}")
#: Closed classes and their tags, in the order of the rules.
_CLOSED = (
    (lexicons.NUMBER_WORDS, "CD"), (lexicons.DETERMINERS, "DT"), (lexicons.PRONOUNS, "PRP"), (lexicons.PREPOSITIONS, "IN"),
    (lexicons.AUXILIARIES, "MD"), (lexicons.CONJUNCTIONS, "CC"), (lexicons.ADVERBS, "RB"),
)


@dataclass(frozen=True)
class RuleAnnotator:
    """Tokens by a regular expression; flags, lemmas, parts of speech and persons by lexicons and rules.

    ``exclude`` and ``keep`` name the components lemmas, tags and entities; ``keep`` wins.
    """

    stop_words: tuple[str, ...] = lexicons.STOP_WORDS
    lemmas: tuple[tuple[str, str], ...] = tuple(lexicons.LEMMAS.items())
    given_names: tuple[str, ...] = lexicons.GIVEN_NAMES
    exclude: tuple[str, ...] = ()
    keep: tuple[str, ...] = ()

    def _has(self, component: str) -> bool:
        return component in self.keep if self.keep else component not in self.exclude

    def annotate(self, text: Column, fields: set[str] | None = None) -> Column:
        raw = F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))
        return let(raw, lambda all_: F.transform(all_, lambda t, i: self._token(t, i, all_, fields)))

    def _token(self, t: Column, i: Column, raw: Column, fields: set[str] | None) -> Column:
        """Nearly all tokens are lower-case ASCII words, marks, or other words of letters only, for which most tests are settled."""
        wanted = lambda every: F.struct(*[c.alias(k) for k, c in every.items() if fields is None or k in fields])
        if fields is not None and not fields - {"pos", "text", "single_char"}:
            return wanted({"pos": i, "text": t, "single_char": F.length(t) < 2})
        capital = t.rlike(r"^\p{Lu}")
        named = self._in(t, self.given_names) | (capital & F.coalesce(F.get(raw, i - 1).isin(*self.given_names), F.lit(False)))
        plain = wanted(self._word(t, t, F.lit(False), self._in(t, [n for n in self.given_names if _PLAIN.fullmatch(n)]), i))
        word = let(F.lower(t), lambda low: wanted(self._word(t, low, capital, named, i)))
        return F.when(t.rlike(r"^[a-z]+\z"), plain).when(t.isin(*_MARKS), wanted(self._mark(t, i))).when(t.rlike(r"^\p{L}+\z"), word).otherwise(wanted(self._any(t, i, raw)))

    @staticmethod
    def _in(t: Column, values) -> Column:
        return t.isin(*values) if values else F.lit(False)

    def _mark(self, t: Column, i: Column) -> dict[str, Column]:
        """The fields of one of ``_MARKS``, as ``_any`` has them."""
        no, yes = F.lit(False), F.lit(True)
        person = self._in(t, [n for n in self.given_names if n in _MARKS]) if self._has("entities") else no
        lemma = reduce(lambda out, x: F.when(t == x[0], F.lit(x[1])).otherwise(out), [x for x in self.lemmas if x[0] in _MARKS] if self._has("lemmas") else [], t)
        tag = F.lit("." if self._has("tags") else "")
        return {
            "pos": i, "text": t, "lemma": lemma, "tag": tag, "pos_tag": self._coarse(tag), "ent_type": F.when(person, F.lit("PERSON")).otherwise(F.lit("")),
            "is_punct": yes, "is_space": no, "is_stop": self._in(t, [w for w in self.stop_words if w in _MARKS]), "like_email": no, "like_url": no, "like_num": no,
            "proper_noun": person, "single_char": yes, "phone_number": no,
        }

    def _word(self, t: Column, low: Column, capital: Column, named: Column, i: Column) -> dict[str, Column]:
        """The fields of a token of letters only, as ``_any`` has them."""
        no, number = F.lit(False), low.isin(*lexicons.NUMBER_WORDS)
        person = named if self._has("entities") else no
        lemma = t
        if self._has("lemmas"):
            known = dict(self.lemmas)
            table = F.when(low.isin(*known), F.try_element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), low)) if known else F.lit(None).cast("string")
            lemma = F.coalesce(table, F.when(t.endswith("s"), self._singular(t)), t)
        tag = F.lit("")
        if self._has("tags"):
            closed = F.lit(None).cast("string")
            for words, name in reversed(_CLOSED):
                closed = F.when(low.isin(*words), F.lit(name)).otherwise(closed)
            ends = lambda *suffixes: reduce(or_, [low.endswith(x) for x in suffixes])
            suffix = F.when(capital, "NNP").when(ends("ly"), "RB").when(ends("ing"), "VBG").when(ends("ed"), "VBD").when(ends("ous", "ful", "able", "ible", "ive", "al", "ic"), "JJ")
            suffix = suffix.when(ends("s") & ~ends("ss") & (F.length(low) > 1), "NNS").otherwise("NN")
            tag = F.when(low.isin(*{w for words, _ in _CLOSED for w in words}), closed).otherwise(suffix)
        return {
            "pos": i, "text": t, "lemma": lemma, "tag": tag, "pos_tag": self._coarse(tag), "ent_type": F.when(person, F.lit("PERSON")).otherwise(F.lit("")),
            "is_punct": no, "is_space": no, "is_stop": self._in(low, self.stop_words), "like_email": no, "like_url": no, "like_num": number,
            "proper_noun": person, "single_char": F.length(t) < 2, "phone_number": number & (F.length(t) >= 9),
        }

    @staticmethod
    def _coarse(tag: Column) -> Column:
        coarse = {
            "CD": "NUM", ".": "PUNCT", "SP": "SPACE", "DT": "DET", "IN": "ADP", "PRP": "PRON", "MD": "AUX", "CC": "CCONJ", "RB": "ADV",
            "NNP": "PROPN", "VBG": "VERB", "VBD": "VERB", "JJ": "ADJ", "NN": "NOUN", "NNS": "NOUN", "ADD": "X", "SYM": "SYMBOL", "": "",
        }
        return F.element_at(F.create_map(*[F.lit(x) for pair in coarse.items() for x in pair]), tag)

    def _any(self, t: Column, i: Column, raw: Column) -> dict[str, Column]:
        low = F.lower(t)
        email = t.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$")
        url = ~email & t.rlike(r"^(?:https?://|www\.)|^[\p{L}\p{N}-]+\.(?:com|org|net|edu|gov|io)$")
        number = t.rlike(r"^\p{Nd}+(?:[.,]\p{Nd}+)*$") | low.isin(*lexicons.NUMBER_WORDS)
        punct = t.rlike(r"^\p{P}+$")
        space = t.rlike(r"^\s+$")
        before = F.get(raw, i - 1)
        capital = t.rlike(r"^\p{Lu}")
        person = (t.isin(*self.given_names) | (capital & F.coalesce(before.isin(*self.given_names), F.lit(False)))) if self._has("entities") else F.lit(False)
        if self._has("lemmas"):
            table = F.create_map(*[F.lit(x) for pair in self.lemmas for x in pair]) if self.lemmas else F.create_map().cast("map<string,string>")
            lemma = F.coalesce(F.try_element_at(table, low), F.when(t.rlike(r"^'(?i:ve)$"), F.lit("have")), self._singular(t), t)
        else:
            lemma = t
        tag = self._tag(t, low, number, punct, space, capital, email | url) if self._has("tags") else F.lit("")
        return {
            "pos": i, "text": t, "lemma": lemma, "tag": tag, "pos_tag": self._coarse(tag), "ent_type": F.when(person, F.lit("PERSON")).otherwise(F.lit("")),
            "is_punct": punct, "is_space": space, "is_stop": low.isin(*self.stop_words), "like_email": email, "like_url": url, "like_num": number,
            "proper_noun": person, "single_char": F.length(t) < 2, "phone_number": number & (F.length(t) >= 9),
        }

    def _singular(self, t: Column) -> Column:
        """A lower-case word in -s without it, by the rules of English plurals; null for other words, stop words among them."""
        stem = F.when(t.rlike("[^aeiou]ies$"), F.regexp_replace(t, "ies$", "y")).when(t.rlike("(?:ss|x|z|ch|sh)es$"), F.regexp_replace(t, "es$", "")).otherwise(F.regexp_replace(t, "s$", ""))
        return F.when(t.rlike("^[a-z]{2,}[^siu]s$") & ~t.isin(*self.stop_words), stem)

    @staticmethod
    def _tag(t, low, number, punct, space, capital, address) -> Column:
        rules = [
            (space, "SP"), (number, "CD"), (address, "ADD"), (punct, "."), (~t.rlike(r"[\p{L}]"), "SYM"),
            (low.isin(*lexicons.DETERMINERS), "DT"), (low.isin(*lexicons.PRONOUNS), "PRP"), (low.isin(*lexicons.PREPOSITIONS), "IN"),
            (low.isin(*lexicons.AUXILIARIES), "MD"), (low.isin(*lexicons.CONJUNCTIONS), "CC"), (low.isin(*lexicons.ADVERBS), "RB"),
            (capital, "NNP"), (low.rlike("ly$"), "RB"), (low.rlike("ing$"), "VBG"), (low.rlike("ed$"), "VBD"),
            (low.rlike("(?:ous|ful|able|ible|ive|al|ic)$"), "JJ"), (low.rlike("[^s]s$"), "NNS"),
        ]
        out = F.lit("NN")
        for condition, tag in reversed(rules):
            out = F.when(condition, F.lit(tag)).otherwise(out)
        return out


_FLAG = {"email": "like_email", "url": "like_url", "phone_number": "phone_number", "number": "like_num", "proper_noun": "proper_noun"}
_FILTERS = (("punct", "is_punct"), ("extra_space", "is_space"), ("stop_words", "is_stop"), ("single_char", "single_char"), *_FLAG.items())


def needed(config: Config) -> set[str]:
    """The token fields that ``selected`` reads under a configuration."""
    return {"lemma" if config.lemmas else "text", *(flag for action, flag in _FILTERS if getattr(config, action))}


def selected(tokens: Column, config: Config) -> Column:
    """The texts (or lemmas) of the tokens that the configuration keeps, masked ones by their mask."""
    masks = [(_FLAG[a], getattr(config, a)) for a in MASKS if isinstance(getattr(config, a), str)]
    drops = [flag for action, flag in _FILTERS if getattr(config, action)]

    def word(t: Column) -> Column:
        kept = t["lemma"] if config.lemmas else t["text"]
        if drops:
            dropped = F.lit(False)
            for f in drops:
                dropped = dropped | t[f]
            kept = F.when(~dropped, kept)
        for f, mask in reversed(masks):
            kept = F.when(t[f], F.lit(mask)).otherwise(kept)
        return kept

    return F.filter(F.transform(tokens, word), lambda w: w.isNotNull())


def rebuilt(words: Column) -> Column:
    """Each word with one space after it, and no space before an apostrophe."""
    return let(words, lambda ws: F.when(F.size(ws) > 0, F.replace(F.concat(F.array_join(ws, " "), F.lit(" ")), F.lit(" '"), F.lit("'"))).otherwise(F.lit("")))


class Pipeline:
    """``fit`` annotates a table lazily; ``transform`` and ``tokenize`` apply the configuration of the moment."""

    def __init__(self, config: dict | Config | None = None, annotator: Annotator | None = None, tables: Lexicons = Lexicons(), id_col: str = "doc_id", text_col: str = "text") -> None:
        self.config = Config.of(config)
        self.annotator = annotator or RuleAnnotator()
        self.tables, self.id_col, self.text_col = tables, id_col, text_col
        self.docs: DataFrame | None = None
        self._source: tuple[DataFrame, DataFrame] | None = None

    def set(self, **actions) -> Pipeline:
        self.config = replace(self.config, **actions)
        return self

    def annotate(self, docs: DataFrame) -> DataFrame:
        """Rows (id, tokens)."""
        return docs.select(self.id_col, self.annotator.annotate(clean(F.col(self.text_col), self.config, self.tables)).alias("tokens"))

    def fit(self, docs: DataFrame) -> Pipeline:
        self.docs = self.annotate(docs)
        self._source = self.docs, docs.select(self.id_col, clean(F.col(self.text_col), self.config, self.tables).alias("__text"))
        return self

    def _selected(self) -> DataFrame:
        """Rows (id, words). An annotation that is not kept anywhere is made with the fields only that the configuration reads."""
        docs = self._fitted()
        if self._source is None or self._source[0] is not docs or docs.is_cached:
            return docs.select(self.id_col, selected(F.col("tokens"), self.config).alias("words"))
        return self._source[1].select(self.id_col, selected(self.annotator.annotate(F.col("__text"), needed(self.config)), self.config).alias("words"))

    def _fitted(self) -> DataFrame:
        if self.docs is None:
            raise NotFitted("call fit first")
        return self.docs

    def transform(self) -> DataFrame:
        """Rows (id, text)."""
        return self._selected().select(self.id_col, rebuilt(F.col("words")).alias(self.text_col))

    def tokenize(self) -> DataFrame:
        """Rows (id, words)."""
        return self._selected()

    def fit_transform(self, docs: DataFrame) -> DataFrame:
        """``transform`` without keeping the annotation: only the fields that the configuration reads are made. Works on a stream."""
        tokens = self.annotator.annotate(clean(F.col(self.text_col), self.config, self.tables), needed(self.config))
        return docs.select(self.id_col, rebuilt(selected(tokens, self.config)).alias(self.text_col))

    def text(self, key) -> str:
        """The transformed text of one document."""
        row = self.transform().where(F.col(self.id_col) == key).first()
        if row is None:
            raise KeyError(key)
        return row[self.text_col]

    def __getitem__(self, key):
        """The tokens of one id, or, for a slice of ids, a pipeline over those."""
        if isinstance(key, slice):
            view = Pipeline(self.config, self.annotator, self.tables, self.id_col, self.text_col)
            keep = F.lit(True)
            if key.start is not None:
                keep = keep & (F.col(self.id_col) >= key.start)
            if key.stop is not None:
                keep = keep & (F.col(self.id_col) < key.stop)
            view.docs = self._fitted().where(keep)
            return view
        row = self._fitted().where(F.col(self.id_col) == key).first()
        if row is None:
            raise KeyError(key)
        return row["tokens"]

    def __len__(self) -> int:
        return self._fitted().count()

    def __str__(self) -> str:
        on = [k for k, v in asdict(self.config).items() if v]
        return f"Pipeline(clean -> {type(self.annotator).__name__} -> select, on: {', '.join(on) or 'nothing'})"

    def save(self, path: str) -> None:
        """The configuration as JSON and the annotation as Parquet under one folder."""
        docs = self._fitted()
        docs.write.mode("overwrite").parquet(f"{path}/docs")
        head = {"config": asdict(self.config), "id_col": self.id_col, "text_col": self.text_col}
        docs.sparkSession.createDataFrame([(json.dumps(head),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/config")

    @classmethod
    def load(cls, spark, path: str, annotator: Annotator | None = None, tables: Lexicons = Lexicons()) -> Pipeline:
        head = json.loads(spark.read.text(f"{path}/config").first()["value"])
        out = cls(head["config"], annotator, tables, head["id_col"], head["text_col"])
        out.docs = spark.read.parquet(f"{path}/docs")
        return out
