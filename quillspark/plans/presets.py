"""Ready-made configurations."""

from __future__ import annotations

from .model import Config, Spec

_LOW = ("unify_case", "normalize_whitespace")


def _s(name: str, **params) -> Spec:
    return Spec(name, params)


def _c(drivers, cullers=(), distance=None, method="nearest_neighbor", canon=_LOW) -> Config:
    return Config(tuple(drivers), tuple(canon), tuple(cullers), distance, method)


PRESETS: dict[str, Config] = {
    "burrows-delta": _c(["word_events"], [_s("most_common", n=150)], None, _s("burrows_delta", n_features=150)),
    "cosine-delta": _c(["word_events"], [_s("most_common", n=300)], "cosine"),
    "char-ngram": _c([_s("character_ngram", n=4)], [_s("most_common", n=2500)], "cosine"),
    "function-words": _c(["function_words"], [], "cosine"),
    "ensemble-svm": _c([_s("character_ngram", n=3), _s("word_ngram", n=2)], [_s("most_common", n=500)], None, _s("svm", kernel="linear")),
    "transformer": _c(["transformer_embeddings"], [], None, _s("svm", kernel="linear"), ()),
    "selma": _c(["selma_embeddings"], [], None, _s("svm", kernel="linear"), ()),
    "eders-delta": _c(["word_events"], [_s("most_common", n=200)], None, _s("eders_delta", top_n=200)),
    "pan-cngdist": _c([_s("character_ngram", n=4)], [_s("most_common", n=3000)], "cosine"),
    "compression-verification": _c(["word_events"], [], _s("ppm", order=5)),
    "forensic-verification": _c(
        [_s("character_ngram", n=4)], [_s("most_common", n=1000)], "cosine",
        _s("imposters", n_iterations=200, random_seed=42, calibration_low=0.35, calibration_high=0.65),
    ),
    "cross-genre": _c(["function_words"], [], None, "contrastive"),
    "perplexity-profile": _c(["perplexity"], [], None, _s("svm", kernel="rbf"), ()),
    "general-imposters": _c([_s("character_ngram", n=4)], [_s("most_common", n=1000)], "cosine", _s("imposters", n_iterations=100, random_seed=42)),
    "unmasking": _c(["word_events"], [], None, _s("unmasking", n_features=250, n_eliminate=6, n_iterations=10, random_seed=42)),
}
