"""Text expressions: trimming, blanks, labels, path tails, search tokens."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every Unicode white-space character, as a regex class body that
# Java and RE2 both read.
SPACE_CLASS = (r"\x09-\x0d\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
               r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
TRIM_PATTERN = f"^[{SPACE_CLASS}]+|[{SPACE_CLASS}]+$"

# A search token is a run of letters, digits, private-use characters and the
# combining marks attached to them.
TOKEN_PATTERN = r"[\p{L}\p{N}\p{Co}\p{Mn}]+"
# A query keeps the underscore inside a token; the index separates on it.
QUERY_TOKEN_PATTERN = r"[\p{IsAlphabetic}\p{N}_]+"

# Display labels of the job kinds.
JOB_KIND_LABELS = {
    "encode_recording": "Encode recording",
    "extract_audio": "Extract audio",
    "run_whisper": "Run Whisper",
    "transcribe_recording": "Transcribe recording",
    "index_transcript": "Index transcript",
    "generate_thumbnail": "Generate thumbnail",
    "ai_summary": "AI summary",
    "clean_temp_files": "Clean temp files",
}

DEFAULT_TITLE = "Untitled recording"
DEFAULT_MODEL = "small.en"


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it many times inside ``body``."""
    return F.get(F.transform(F.array(value), body), 0)


def _fold_map() -> tuple[str, str]:
    """Lower-case Latin letters that decompose to one base letter plus marks."""
    source, target = [], []
    for code in list(range(0xC0, 0x250)) + list(range(0x1E00, 0x1F00)):
        letter = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFD", letter)
                       if not unicodedata.combining(c))
        if letter == letter.lower() and letter != base and len(base) == 1 and base.isalpha():
            source.append(letter)
            target.append(base)
    return "".join(source), "".join(target)


FOLD_FROM, FOLD_TO = _fold_map()


def trim_space(c: Column) -> Column:
    return F.regexp_replace(c, TRIM_PATTERN, "")


def has_words(c: Column) -> Column:
    """Whether a text has any character that is not white space; stops at the first."""
    return c.rlike(f"[^{SPACE_CLASS}]")


def blank_to_null(c: Column) -> Column:
    return F.nullif(trim_space(c), F.lit(""))


def normal_title(c: Column) -> Column:
    return F.coalesce(blank_to_null(c), F.lit(DEFAULT_TITLE))


def is_ascii(text: Column) -> Column:
    """True when every character takes one byte."""
    return F.octet_length(text) == F.char_length(text)


def raw_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))


def index_tokens(text: Column) -> Column:
    """Folded tokens of a text in order, one per raw token; empty for a null text.

    The text is folded as a whole, which keeps token borders. ASCII texts take a plain
    pattern, and only texts that hold combining marks pay for a step per token.
    """
    lower = F.lower(text)
    plain = F.regexp_extract_all(lower, F.lit("[a-z0-9]+"), F.lit(0))
    tokens = raw_tokens(F.translate(lower, FOLD_FROM, FOLD_TO))
    bare = F.transform(tokens, lambda t: F.regexp_replace(t, r"\p{Mn}+", ""))
    return F.coalesce(
        F.when(is_ascii(text), plain).when(lower.rlike(r"\p{Mn}"), bare).otherwise(tokens),
        F.array().cast("array<string>"))


def query_tokens(query: Column) -> Column:
    """Tokens of a search query: ASCII lower case, underscores kept inside."""
    lowered = F.translate(query, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(F.regexp_extract_all(lowered, F.lit(QUERY_TOKEN_PATTERN), F.lit(0)),
                      F.array().cast("array<string>"))


def query_phrases(query: Column) -> Column:
    """Each query token as the list of index words it stands for.

    A token holding an underscore becomes a phrase of adjacent words.
    """
    return F.transform(query_tokens(query), index_tokens)


def job_kind_label(kind: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in JOB_KIND_LABELS.items() for x in pair])
    words = F.transform(
        F.split(kind, "_"),
        lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))))
    return F.coalesce(F.try_element_at(known, kind), F.array_join(words, " "))


def path_tail(path: Column) -> Column:
    parts = F.filter(F.split(path, r"[\\/]"), lambda p: p != "")
    tail = F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2)
    return F.when(F.coalesce(path, F.lit("")) == "", F.lit("Pending")).otherwise(
        F.array_join(tail, "/"))


def stable_id(*parts: Column) -> Column:
    """Deterministic row id: a lost task that is run again makes the same id."""
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary"))


def model_name(raw: Column) -> tuple[Column, Column]:
    """Normalised recogniser model name and the reason it is refused, if any."""
    name = F.coalesce(blank_to_null(raw), F.lit(DEFAULT_MODEL))
    name = F.regexp_replace(F.regexp_replace(name, "^ggml-", ""), r"\.bin$", "")
    error = (
        F.when(name.contains("/") | name.contains("\\") | name.contains(".."),
               F.lit("model name must be a local file name"))
        .when(name == "", F.lit("model name is required"))
        .when(~name.rlike(r"^[A-Za-z0-9._-]+$"), F.lit("model name has unsupported characters")))
    return F.when(error.isNull(), name), error


def compact_error(body: Column, limit: int = 500) -> Column:
    return F.when(F.length(body) > limit, F.concat(F.left(body, F.lit(limit)), F.lit("..."))
                  ).otherwise(body)


def resolve_path(path: Column, root: str) -> Column:
    """Absolute paths stay, relative ones are joined to the library root."""
    return F.when(path.startswith("/"), path).otherwise(
        F.concat(F.lit(root.rstrip("/") + "/"), path))
