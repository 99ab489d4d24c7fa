"""Word lexicons of lines /word/value/."""

from __future__ import annotations

import re

_LINE = re.compile(r"^/([^/]*)/([^/]*)/\s*$")

#: Small invented samples; real norms are a file of the same form.
SAMPLE_TIMES = {"the": "540", "of": "561", "and": "548", "to": "552", "in": "545", "is": "559", "that": "571", "with": "583", "for": "566", "this": "562"}
SAMPLE_FREQUENCIES = {"the": "16.9", "of": "16.1", "and": "16.2", "to": "16.0", "in": "15.7", "is": "15.3", "that": "15.2", "with": "14.6", "for": "14.9", "this": "14.5"}


def load_lexicon(path: str) -> dict[str, str]:
    """Lower-cased words and their values; # begins a comment, and of repeated words the last counts."""
    out: dict[str, str] = {}
    with open(path, encoding="utf-8") as f:
        for line in f:
            if not line.startswith("#") and (m := _LINE.match(line.strip())):
                out[m[1].lower()] = m[2]
    return out
