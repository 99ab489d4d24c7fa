"""Event drivers: from a text column to an array of events (strings), or of numbers.

A driver is a function (DataFrame, text column name) -> DataFrame with a column ``events``. Arrays that a lambda
reads are bound to a column first: written inline they would be computed again for every element.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.model import DRIVERS, TOKENIZERS, BadPipeline, LoadError, Param
from .porter import stem
from .text import chars, ngrams, nothing, run_of
from .word_lists import FUNCTION_WORDS, MOSTELLER_WALLACE

Driver = Callable[[DataFrame, str], DataFrame]
TOKENIZER = Param("tokenizer", "whitespace")


def _over(make: Callable[[Column], Column], bind: Callable[[Column], Column]) -> Driver:
    """events = make(bound array)."""
    def run(df: DataFrame, text: str) -> DataFrame:
        return df.withColumn("__a", bind(F.col(text))).withColumn("events", F.coalesce(make(F.col("__a")), nothing())).drop("__a")

    return run


def _tok(name: str) -> Callable[[Column], Column]:
    return TOKENIZERS.create(name)


def _text(x: Column) -> Column:
    return x.cast("string")


def _sentences(t: Column) -> Column:
    return F.split(t, "[.!?]+")


@DRIVERS.register("character_ngram", Param("n", 3, 1, 20))
def character_ngram(n: int) -> Driver:
    """Overlapping runs of n characters."""
    return _over(lambda a: ngrams(a, n, ""), chars)


@DRIVERS.register("word_events", TOKENIZER)
def word_events(tokenizer: str) -> Driver:
    """Words."""
    return _over(lambda a: a, _tok(tokenizer))


@DRIVERS.register("word_ngram", Param("n", 2, 1, 10), TOKENIZER)
def word_ngram(n: int, tokenizer: str) -> Driver:
    """Runs of n words."""
    return _over(lambda a: ngrams(a, n, " "), _tok(tokenizer))


def _listed(listed: frozenset[str], tokenizer: str) -> Driver:
    values = sorted(listed)
    return _over(lambda a: F.filter(F.transform(a, F.lower), lambda x: x.isin(values)), _tok(tokenizer))


def load_function_words(language: str) -> frozenset[str]:
    if language not in FUNCTION_WORDS:
        raise LoadError(f"no function words for {language}; there are {', '.join(sorted(FUNCTION_WORDS))}")
    return FUNCTION_WORDS[language]


@DRIVERS.register("function_words", Param("language", "english"), TOKENIZER, Param("words", ""))
def function_words(language: str, tokenizer: str, words: str) -> Driver:
    """Function words of a language, lower-cased; or those of a list of one's own (a file, a word a line)."""
    return _listed(words_among("function_words", {"language": language, "words": words}), tokenizer)


def words_among(name: str, p: dict) -> frozenset[str]:
    """The words that a driver of function words with these parameters keeps."""
    if name == "mw_function_words":
        return MOSTELLER_WALLACE
    if p["words"]:
        with open(p["words"], encoding="utf-8") as f:
            return frozenset(w.strip().lower() for w in f if w.strip())
    return load_function_words(p["language"])


@DRIVERS.register("word_length", TOKENIZER)
def word_length(tokenizer: str) -> Driver:
    """Length of each word."""
    return _over(lambda a: F.transform(a, lambda x: _text(F.length(x))), _tok(tokenizer))


@DRIVERS.register("sentence_length", TOKENIZER)
def sentence_length(tokenizer: str) -> Driver:
    """Words in each sentence that has any."""
    tok = _tok(tokenizer)
    return _over(lambda a: F.transform(F.filter(F.transform(a, lambda s: F.size(tok(s))), lambda n: n > 0), _text), _sentences)


@DRIVERS.register("character_events")
def character_events() -> Driver:
    """Characters."""
    return _over(lambda a: a, chars)


@DRIVERS.register("punctuation")
def punctuation() -> Driver:
    """Characters that are neither letters, digits nor white space."""
    return _over(lambda a: F.filter(a, lambda c: c.rlike(r"(?U)^[^\p{L}\p{N}\s\x1c-\x1f]$")), chars)


@DRIVERS.register("punctuation_ngram", Param("n", 2, 1, 10))
def punctuation_ngram(n: int) -> Driver:
    """Runs of n ASCII punctuation marks, whatever stands between."""
    return _over(lambda a: ngrams(a, n, ""), lambda t: chars(F.regexp_replace(t, r"[^\p{Punct}]", "")))


@DRIVERS.register("mw_function_words", TOKENIZER)
def mw_function_words(tokenizer: str) -> Driver:
    """The function words of Mosteller and Wallace."""
    return _listed(words_among("mw_function_words", {}), tokenizer)


def _leave_out(n: int, k: int, bind: Callable[[Column], Column]) -> Driver:
    if k >= n:
        return _over(lambda a: nothing(), bind)
    masks = list(itertools.combinations(range(n), k))

    def make(a: Column) -> Column:
        def grams(i: Column) -> Column:
            return F.array(*[F.concat_ws(" ", *[F.lit("_") if j in m else F.element_at(a, i + j) for j in range(n)]) for m in masks])

        return F.when(F.size(a) >= n, F.flatten(F.transform(F.sequence(F.lit(1), F.size(a) - (n - 1)), grams))).otherwise(nothing())

    return _over(make, bind)


@DRIVERS.register("leave_k_out_character_ngram", Param("n", 3, 2, 10), Param("k", 1, 1, 5))
def leave_k_out_character_ngram(n: int, k: int) -> Driver:
    """Character n-grams with every choice of k places masked."""
    return _leave_out(n, k, chars)


@DRIVERS.register("leave_k_out_word_ngram", Param("n", 3, 2, 10), Param("k", 1, 1, 5), TOKENIZER)
def leave_k_out_word_ngram(n: int, k: int, tokenizer: str) -> Driver:
    """Word n-grams with every choice of k places masked."""
    return _leave_out(n, k, _tok(tokenizer))


def _sorted_grams(n: int, sep: str, bind: Callable[[Column], Column]) -> Driver:
    return _over(
        lambda a: F.when(F.size(a) >= n, F.transform(F.sequence(F.lit(1), F.size(a) - (n - 1)), lambda i: F.array_join(F.array_sort(F.array(*run_of(a, i, n))), sep))).otherwise(nothing()),
        bind,
    )


@DRIVERS.register("sorted_character_ngram", Param("n", 3, 1, 20))
def sorted_character_ngram(n: int) -> Driver:
    """Character n-grams, each sorted."""
    return _sorted_grams(n, "", chars)


@DRIVERS.register("sorted_word_ngram", Param("n", 2, 1, 10), TOKENIZER)
def sorted_word_ngram(n: int, tokenizer: str) -> Driver:
    """Word n-grams, each sorted."""
    return _sorted_grams(n, " ", _tok(tokenizer))


def _skip_grams(n: int, k: int, sep: str, bind: Callable[[Column], Column]) -> Driver:
    span = (n - 1) * (k + 1)

    def make(a: Column) -> Column:
        gram = lambda i: F.concat_ws(sep, *[F.element_at(a, i + j * (k + 1)) for j in range(n)])
        return F.when(F.size(a) > span, F.transform(F.sequence(F.lit(1), F.size(a) - span), gram)).otherwise(nothing())

    return _over(make, bind)


@DRIVERS.register("k_skip_character_ngram", Param("n", 2, 1, 20), Param("k", 1, 0, 10))
def k_skip_character_ngram(n: int, k: int) -> Driver:
    """n characters, each k + 1 after the one before."""
    return _skip_grams(n, k, "", chars)


@DRIVERS.register("k_skip_word_ngram", Param("n", 2, 1, 10), Param("k", 1, 0, 10), TOKENIZER)
def k_skip_word_ngram(n: int, k: int, tokenizer: str) -> Driver:
    """n words, each k + 1 after the one before."""
    return _skip_grams(n, k, " ", _tok(tokenizer))


@DRIVERS.register("suffix", Param("length", 3, 1, 10), TOKENIZER)
def suffix(length: int, tokenizer: str) -> Driver:
    """Last characters of words that have as many."""
    return _over(lambda a: F.transform(F.filter(a, lambda x: F.length(x) >= length), lambda x: F.right(x, F.lit(length))), _tok(tokenizer))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stems(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    known: dict[str, str] = {}
    for s in batches:
        out = []
        for ws in s:
            if ws is None:
                out.append(None)
                continue
            for w in ws:
                if w not in known:
                    if len(known) > 500_000:
                        known.clear()
                    known[w] = stem(w)
            out.append([known[w] for w in ws])
        yield pd.Series(out, dtype=object)


@DRIVERS.register("porter_stemmer", TOKENIZER)
def porter_stemmer(tokenizer: str) -> Driver:
    """Porter stems of the lower-cased words; each distinct word is stemmed once a task."""
    return _over(lambda a: _stems(F.transform(a, F.lower)), _tok(tokenizer))


@F.pandas_udf(T.ArrayType(T.LongType()))
def _own_counts(ws: pd.Series) -> pd.Series:
    """How often each word stands in its document."""
    out = []
    for a in ws:
        if a is None:
            out.append(None)
        else:
            n: dict[str, int] = {}
            for w in a:
                n[w] = n.get(w, 0) + 1
            out.append([n[w] for w in a])
    return pd.Series(out, dtype=object)


def _with_counts(tokenizer: str, make: Callable[[Column], Column]) -> Driver:
    """events from (word, count in the document) pairs."""
    return _over(make, lambda t: F.arrays_zip(_tok(tokenizer)(t).alias("w"), _own_counts(_tok(tokenizer)(t)).alias("n")))


@DRIVERS.register("rare_words", Param("min_count", 1, 1), Param("max_count", 1, 1), TOKENIZER)
def rare_words(min_count: int, max_count: int, tokenizer: str) -> Driver:
    """Words whose count in the document is within a range."""
    return _with_counts(tokenizer, lambda a: F.transform(F.filter(a, lambda x: x["n"].between(min_count, max_count)), lambda x: x["w"]))


@DRIVERS.register("vowel_initial_words", TOKENIZER)
def vowel_initial_words(tokenizer: str) -> Driver:
    """Words that begin with a vowel."""
    return _over(lambda a: F.filter(a, lambda x: x.rlike("^[aeiouAEIOU]")), _tok(tokenizer))


@DRIVERS.register("first_word_in_sentence", TOKENIZER)
def first_word_in_sentence(tokenizer: str) -> Driver:
    """First word of each sentence."""
    tok = _tok(tokenizer)
    return _over(lambda a: F.filter(F.transform(a, lambda s: F.get(tok(s), 0)), lambda x: x.isNotNull()), _sentences)


def _trimmed(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


@DRIVERS.register("sentence_events")
def sentence_events() -> Driver:
    """Sentences."""
    return _over(lambda a: F.filter(F.transform(a, _trimmed), lambda x: x != ""), lambda t: F.split(t, r"(?U)(?<=[.!?])[\s\x1c-\x1f]+"))


@DRIVERS.register("line_length", TOKENIZER)
def line_length(tokenizer: str) -> Driver:
    """Words in each line that has any."""
    tok = _tok(tokenizer)
    return _over(lambda a: F.transform(F.filter(F.transform(a, lambda s: F.size(tok(s))), lambda n: n > 0), _text), lambda t: F.split(t, "\n"))


@DRIVERS.register("new_lines")
def new_lines() -> Driver:
    """Lines that aren't blank."""
    return _over(lambda a: F.filter(F.transform(a, _trimmed), lambda x: x != ""), lambda t: F.split(t, "\n"))


@DRIVERS.register("mn_letter_words", Param("m", 1, 1, 50), Param("n", 3, 1, 50), TOKENIZER)
def mn_letter_words(m: int, n: int, tokenizer: str) -> Driver:
    """Words of m to n letters."""
    return _over(lambda a: F.filter(a, lambda x: F.length(x).between(m, n)), _tok(tokenizer))


@DRIVERS.register("vowel_mn_letter_words", Param("m", 1, 1, 50), Param("n", 5, 1, 50), TOKENIZER)
def vowel_mn_letter_words(m: int, n: int, tokenizer: str) -> Driver:
    """Words of m to n letters that begin with a vowel."""
    return _over(lambda a: F.filter(a, lambda x: F.length(x).between(m, n) & x.rlike("^[aeiouAEIOU]")), _tok(tokenizer))


def _syllables(a: Column) -> Column:
    return F.transform(a, lambda x: _text(F.greatest(F.lit(1), F.regexp_count(x, F.lit("[aeiouyAEIOUY]+")))))


@DRIVERS.register("syllables_per_word", TOKENIZER)
def syllables_per_word(tokenizer: str) -> Driver:
    """Vowel runs of each word, one at least."""
    return _over(_syllables, _tok(tokenizer))


@DRIVERS.register("syllable_transitions", Param("n", 2, 1, 10), TOKENIZER)
def syllable_transitions(n: int, tokenizer: str) -> Driver:
    """Runs of n syllable counts."""
    return _over(lambda a: ngrams(a, n, " "), lambda t: _syllables(_tok(tokenizer)(t)))


@DRIVERS.register("truncated_frequency", TOKENIZER)
def truncated_frequency(tokenizer: str) -> Driver:
    """Whole part of the binary logarithm of each word's count in the document."""
    return _with_counts(tokenizer, lambda a: F.transform(a, lambda x: _text(F.length(F.bin(x["n"])) - 1)))


def lexicon_driver(tokenizer: str, table: dict[str, str]) -> Driver:
    """Words looked up in lower case; those not listed are dropped."""
    pairs = [F.lit(v) for kv in sorted(table.items()) for v in kv]
    if not pairs:
        return _over(lambda a: nothing(), _tok(tokenizer))
    look = F.create_map(*pairs)
    return _over(lambda a: F.filter(F.transform(a, lambda x: look[F.lower(x)]), lambda v: v.isNotNull()), _tok(tokenizer))


@DRIVERS.register("reaction_time", Param("measure", "rt"), TOKENIZER, Param("lexicon", ""))
def reaction_time(measure: str, tokenizer: str, lexicon: str) -> Driver:
    """Values of a lexicon of lines /word/value/ (a file; ``measure`` names one of the two built-in samples without it)."""
    from ..sources.lexicon import SAMPLE_FREQUENCIES, SAMPLE_TIMES, load_lexicon

    table = load_lexicon(lexicon) if lexicon else SAMPLE_FREQUENCIES if measure == "freq" else SAMPLE_TIMES
    return lexicon_driver(tokenizer, table)


STOP_WORDS = frozenset(
    "that it if yet so not nor or but and through into as from by at on with for to in of must could can might may should shall would will did do"
    " does had has have being been be were was are is the an a".split()
)


@DRIVERS.register("definitions", TOKENIZER, Param("glossary", ""))
def definitions(tokenizer: str, glossary: str) -> Driver:
    """Content words of each word's gloss: from a glossary file (word, tab, gloss) or, without one, from WordNet."""
    def content(gloss: str) -> list[str]:
        ws = ["".join(c for c in w if c.isascii() and c.isalpha()).lower() for w in gloss.split()]
        return [w for w in ws if len(w) > 1 and w not in STOP_WORDS]

    if glossary:
        with open(glossary, encoding="utf-8") as f:
            table = {k.lower(): content(v) for k, _, v in (line.rstrip("\n").partition("\t") for line in f) if k}

        def gloss(word: str) -> list[str]:
            return table.get(word, [])
    else:
        def gloss(word: str) -> list[str]:
            try:
                from nltk.corpus import wordnet
            except ImportError as e:
                raise LoadError("definitions need a glossary file or nltk with WordNet") from e
            found = wordnet.synsets(word)
            return content(found[0].definition()) if found else []

    def look(s: pd.Series) -> pd.Series:
        return s.map(lambda ws: None if ws is None else [d for w in ws for d in gloss(w.lower())])

    return _over(lambda a: F.pandas_udf(look, "array<string>")(a), _tok(tokenizer))


# --- drivers that need a language model; a parser is any callable text -> list of token dicts ---

COARSE = dict(
    NOUN="N", PROPN="N", VERB="V", AUX="V", ADJ="J", ADV="R", PRON="D", DET="D", ADP="P", CCONJ="C", SCONJ="C", PART="T", INTJ="I", NUM="M",
    PUNCT=".", SYM=".", X="X", SPACE="_",
)
#: Parsers by model name, for models other than spaCy's; each gives tokens as dicts with text, pos, dep, head, vector, and entities as (label, text, start, end).
PARSERS: dict[str, Callable[[str], tuple[list[dict], list[tuple[str, str, int, int]]]]] = {}


def _parse(model: str) -> Callable[[str], tuple[list[dict], list[tuple[str, str, int, int]]]]:
    if model in PARSERS:
        return PARSERS[model]
    try:
        import spacy
    except ImportError as e:
        raise LoadError(f"no parser named {model}; register one in PARSERS or install spacy") from e
    nlp = spacy.load(model)

    def parse(text: str):
        doc = nlp(text)
        tokens = [{"text": t.text, "pos": t.pos_, "dep": t.dep_, "head": t.head.i, "vector": t.vector.tolist()} for t in doc]
        return tokens, [(e.label_, e.text, e.start, e.end) for e in doc.ents]

    return parse


def _parsed(model: str, make: Callable[[list[dict], list], list], kind: str = "array<string>") -> Callable[[Column], Column]:
    registered = PARSERS.get(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        parse = registered or _parse(model)
        for s in batches:
            yield s.map(lambda t: None if t is None else make(*parse(t)))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, kind)


MODEL = Param("model", "en_core_web_sm")


@DRIVERS.register("pos_tags", MODEL)
def pos_tags(model: str) -> Driver:
    """Part of speech of each token."""
    return _over(lambda a: a, _parsed(model, lambda t, e: [x["pos"] for x in t]))


@DRIVERS.register("coarse_pos_tags", MODEL)
def coarse_pos_tags(model: str) -> Driver:
    """Broad part of speech of each token."""
    return _over(lambda a: a, _parsed(model, lambda t, e: [COARSE.get(x["pos"], "X") for x in t]))


@DRIVERS.register("pos_ngram", Param("n", 2, 1, 10), MODEL)
def pos_ngram(n: int, model: str) -> Driver:
    """Runs of n parts of speech."""
    return _over(lambda a: ngrams(a, n, " "), _parsed(model, lambda t, e: [x["pos"] for x in t]))


@DRIVERS.register("named_entities", MODEL)
def named_entities(model: str) -> Driver:
    """Label of each entity."""
    return _over(lambda a: a, _parsed(model, lambda t, e: [x[0] for x in e]))


@DRIVERS.register("entity_text", MODEL)
def entity_text(model: str) -> Driver:
    """Text of each entity."""
    return _over(lambda a: a, _parsed(model, lambda t, e: [x[1] for x in e]))


@DRIVERS.register("entity_context", MODEL)
def entity_context(model: str) -> Driver:
    """The tokens before and behind each entity."""
    def make(t: list[dict], ents: list) -> list[str]:
        out = []
        for _, _, a, b in ents:
            out += [f"BEFORE:{t[a - 1]['text']}"] if a > 0 else []
            out += [f"AFTER:{t[b]['text']}"] if b < len(t) else []
        return out

    return _over(lambda a: a, _parsed(model, make))


# --- numeric drivers: vectors instead of events ---

#: Encoders by model name: texts -> vectors; used instead of the transformers library where registered.
ENCODERS: dict[str, Callable[[list[str]], list[list[float]]]] = {}
#: Language models by name: text -> surprisal in nats of each token.
LANGUAGE_MODELS: dict[str, Callable[[str], list[float]]] = {}


def _numbers(run: Callable[[Iterator[pd.Series]], Iterator[pd.Series]]) -> Driver:
    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    udf = F.pandas_udf(run, "array<double>")

    def apply(df: DataFrame, text: str) -> DataFrame:
        return df.withColumn("events", udf(F.col(text)))

    return apply


def _embedder(name: str, fallback: Callable[[], Callable[[list[str]], list[list[float]]]]) -> Driver:
    registered = ENCODERS.get(name)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = registered or fallback()
        for s in batches:
            yield pd.Series([list(map(float, v)) for v in encode([t or "" for t in s])], dtype=object)

    return _numbers(run)


@DRIVERS.register("transformer_embeddings", Param("model_name", "sentence-transformers/all-MiniLM-L6-v2"), Param("max_length", 512, 1), traits=("numeric",))
def transformer_embeddings(model_name: str, max_length: int) -> Driver:
    """Mean of a transformer's last hidden states over the tokens that aren't padding."""
    def load() -> Callable[[list[str]], list[list[float]]]:
        try:
            import torch
            from transformers import AutoModel, AutoTokenizer
        except ImportError as e:
            raise LoadError(f"no encoder named {model_name}; register one in ENCODERS or install transformers and torch") from e
        tok, net = AutoTokenizer.from_pretrained(model_name), AutoModel.from_pretrained(model_name).eval()

        def encode(texts: list[str]) -> list[list[float]]:
            with torch.no_grad():
                x = tok(texts, return_tensors="pt", truncation=True, max_length=max_length, padding=True)
                h, m = net(**x).last_hidden_state, x["attention_mask"].unsqueeze(-1).float()
                return ((h * m).sum(1) / m.sum(1).clamp(min=1e-9)).tolist()

        return encode

    return _embedder(model_name, load)


@DRIVERS.register(
    "selma_embeddings", Param("model_name", "intfloat/e5-mistral-7b-instruct"), Param("max_length", 4096, 1),
    Param("instruction", "Retrieve stylistically similar text"), traits=("numeric",),
)
def selma_embeddings(model_name: str, max_length: int, instruction: str) -> Driver:
    """Instruction-prefixed embeddings: the last token's state, scaled to length one."""
    registered = ENCODERS.get(model_name)

    def load() -> Callable[[list[str]], list[list[float]]]:
        try:
            import torch
            from transformers import AutoModel, AutoTokenizer
        except ImportError as e:
            raise LoadError(f"no encoder named {model_name}; register one in ENCODERS or install transformers and torch") from e
        tok, net = AutoTokenizer.from_pretrained(model_name), AutoModel.from_pretrained(model_name).eval()

        def encode(texts: list[str]) -> list[list[float]]:
            out = []
            with torch.no_grad():
                for t in texts:  # one by one, so that the last state is that of the last token and not of padding
                    out.append(net(**tok(t, return_tensors="pt", truncation=True, max_length=max_length)).last_hidden_state[0, -1].tolist())
            return out

        return encode

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = registered or load()
        for s in batches:
            v = np.array(encode([f"Instruct: {instruction}\nQuery: {t or ''}" for t in s]), float)
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            yield pd.Series(v.tolist(), dtype=object)

    return _numbers(run)


def surprisal_profile(x: list[float]) -> list[float]:
    """Mean, variance, skewness and excess kurtosis (population moments); NaN for nothing."""
    if not x:
        return [math.nan] * 4
    v = np.array(x, float)
    mean, var = v.mean(), v.var()
    std = max(math.sqrt(var), 1e-12)
    z = (v - mean) / std
    return [float(mean), float(var), float((z**3).mean()), float((z**4).mean() - 3)]


@DRIVERS.register("perplexity", Param("model_name", "gpt2"), Param("max_length", 1024, 1), traits=("numeric",))
def perplexity(model_name: str, max_length: int) -> Driver:
    """Moments of a language model's surprisal over the tokens."""
    registered = LANGUAGE_MODELS.get(model_name)

    def load() -> Callable[[str], list[float]]:
        try:
            import torch
            from transformers import AutoModelForCausalLM, AutoTokenizer
        except ImportError as e:
            raise LoadError(f"no language model named {model_name}; register one in LANGUAGE_MODELS or install transformers and torch") from e
        tok, net = AutoTokenizer.from_pretrained(model_name), AutoModelForCausalLM.from_pretrained(model_name).eval()

        def surprisal(text: str) -> list[float]:
            ids = tok(text, return_tensors="pt", truncation=True, max_length=max_length).input_ids
            if ids.shape[1] < 2:
                return []
            with torch.no_grad():
                logs = torch.log_softmax(net(ids).logits[0, :-1], dim=-1)
            return (-logs.gather(1, ids[0, 1:, None])[:, 0]).tolist()

        return surprisal

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        surprisal = registered or load()
        for s in batches:
            yield s.map(lambda t: surprisal_profile(surprisal(t or "")))

    return _numbers(run)


def _weights(seed: int, layer: int, rows: int, cols: int) -> np.ndarray:
    """Fixed pseudo-random weights in [-1, 1) / sqrt(rows) from MD5."""
    flat = [int.from_bytes(hashlib.md5(f"{seed}:{layer}:{i}:{j}".encode()).digest()[:8], "big") / 2**63 - 1 for i in range(rows) for j in range(cols)]
    return np.array(flat).reshape(rows, cols) / math.sqrt(max(rows, 1))


@DRIVERS.register(
    "gnn_embeddings", Param("spacy_model", "en_core_web_md"), Param("hidden_dim", 64, 1), Param("n_layers", 2, 1), Param("pooling", "mean", choices=("mean", "max", "sum")),
    Param("random_seed", 42), traits=("numeric",),
)
def gnn_embeddings(spacy_model: str, hidden_dim: int, n_layers: int, pooling: str, random_seed: int) -> Driver:
    """A graph network with fixed weights over the dependency graph: vectors, parts of speech and relations as node features."""
    def make(tokens: list[dict], _: list) -> list[float]:
        if not tokens:
            return [0.0] * hidden_dim
        pos, dep = sorted({t["pos"] for t in tokens}), sorted({t["dep"] for t in tokens})
        x = np.array([list(t["vector"]) + [float(t["pos"] == p) for p in pos] + [float(t["dep"] == d) for d in dep] for t in tokens])
        a = np.eye(len(tokens))
        for i, t in enumerate(tokens):
            a[i, t["head"]] = a[t["head"], i] = 1
        a /= a.sum(axis=1, keepdims=True)
        for layer in range(n_layers):
            x = np.maximum(a @ x @ _weights(random_seed, layer, x.shape[1], hidden_dim), 0)
        return {"mean": x.mean(axis=0), "max": x.max(axis=0), "sum": x.sum(axis=0)}[pooling].tolist()

    parse = _parsed(spacy_model, make, "array<double>")
    return lambda df, text: df.withColumn("events", parse(F.col(text)))


def is_numeric(name: str) -> bool:
    return "numeric" in DRIVERS.get(name).traits


def extract(df: DataFrame, text: str, specs: list) -> tuple[DataFrame, bool]:
    """df with ``events``: all drivers' events one after the other; and whether they are numbers."""
    kinds = {is_numeric(s.name) for s in specs}
    if len(kinds) > 1:
        raise BadPipeline("numeric and discrete event drivers do not mix")
    names = []
    for k, s in enumerate(specs):
        df = DRIVERS.create(s.name, s.params)(df, text).withColumnRenamed("events", f"__e{k}")
        names.append(f"__e{k}")
    return df.withColumn("events", F.concat(*names) if len(names) > 1 else F.col(names[0])).drop(*names), kinds == {True}
