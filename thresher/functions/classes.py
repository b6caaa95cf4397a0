r"""Character classes, word lists and limits, in one place for Python, Java and RE2 patterns.

Everything in this module is a fixed value: results must equal those of other implementations of
the same compression, so the lists are stated as they are.
"""

from __future__ import annotations

import re

import numpy as np

# Inclusive ranges of code points.
SPACE = [(0x20, 0x20), (0x09, 0x0D), (0x85, 0x85), (0xA0, 0xA0), (0x2000, 0x200B), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000), (0xFEFF, 0xFEFF)]
PUNCT = [(0x2010, 0x2027), (0x2030, 0x205E), (0x3001, 0x303F), (0xFE50, 0xFE6F), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65)]
DENSE = [(0x0E00, 0x0E7F), (0x0E80, 0x0EFF), (0x1000, 0x109F), (0x1100, 0x11FF), (0x1780, 0x17FF), (0x3040, 0x309F), (0x30A0, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0xF900, 0xFAFF)]
ASCII_OTHER = [(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)]

# Words and phrases.
ABBREVIATIONS = ["mr", "mrs", "ms", "dr", "prof", "sr", "jr", "st", "vs", "etc", "e.g", "i.e", "cf", "al", "approx", "no", "fig", "eq", "sec", "min", "max", "avg"]
FILLERS = ["basically", "essentially", "as mentioned", "as noted", "as discussed", "as you can see", "in other words", "needless to say", "it goes without saying", "to be honest", "in my opinion", "i think that", "it is worth noting", "it's worth noting", "obviously", "of course"]
PROHIBITIONS = ["do not", "don't", "must not", "never "]
CONSTRAINTS = ["must ", "always", "only ", "except", "required", "important", "warning", "note:", "make sure", "be careful"]
ANAPHORA = ["this", "that", "these", "those", "it", "they", "however", "therefore", "thus", "so", "consequently", "instead", "otherwise", "also", "additionally", "hence"]
STOPWORDS = (
    "a an the and or but if then else when at by for with about against between into through during before after above below to from "
    "up down in out on off over under again further once here there all any both each few more most other some such only own same "
    "so than too very can will just should now is are was were be been being have has had having do does did doing would could "
    "ought i you he she it we they them his her its our their this that these those am of as not no nor what which who whom"
).split()
ERROR_MARKERS = ["Traceback (most recent call last):", "Uncaught exception", "UnhandledPromiseRejection", "thread 'main' panicked at", "panic: ", "Exception in thread", "FATAL: ", "ERROR: ", "Error: ", "Exception: ", "java.lang."]
CODE_PREFIXES = ["def ", "class ", "function ", "async function ", "import ", "from ", "export ", "package ", "#include", "fn ", "pub fn ", "func ", "var ", "const ", "let "]
STRUCTURAL_MARKERS = ["```", "Traceback (most recent call last)"]
PURGED = "[errored output purged for context compaction]"
LABELS = ["unknown", "prose", "code", "error", "structured", "repeat", "long_important"]

# Weights and limits of sentence scores and of compression.
DIGIT, ENTITY, QUOTED, IDENTIFIER, POSITION, IMPERATIVE, FILLER = 350, 200, 200, 300, 250, 400, 400
SCALE, REDUNDANT_PERCENT, WHOLE_LINE, LEAST_SENTENCES, LEAST_TOKENS, ASCII_PERCENT = 1000, 60, 12, 3, 40, 60
STRUCTURED_LENGTH, CODE_LINES = 200, 2


def pattern(*ranges: list[tuple[int, int]], style: str = "java") -> str:
    """The inside of a character class.  Java and RE2 read the same text; Python has escapes of its own."""
    form = "\\u{:04x}" if style == "python" else "\\x{{{:x}}}"
    return "".join(form.format(a) + (f"-{form.format(b)}" if b > a else "") for some in ranges for a, b in some)


SPACE_CLASS = pattern(SPACE)
NOT_WORD = pattern(ASCII_OTHER, SPACE, PUNCT)
DENSE_CLASS = pattern(DENSE)
#: Four word characters, or one that isn't a space, at a time.
CHUNK = f"[^{NOT_WORD}{DENSE_CLASS}]{{1,4}}|[^{SPACE_CLASS}]"
DENSE_CHUNK = f"[{DENSE_CLASS}]{{3}}"
WORD = f"[^{NOT_WORD}]+"
TRIM = f"^[{SPACE_CLASS}]+|[{SPACE_CLASS}]+$"
LIST_LINE = r"^(?:\||[-*+] .|[0-9]+[.)] )"
JSON_KEY = r'"[^"\n]{1,64}"[ \t]*:'
ENTITY_SIGNAL = r"(?s)^[^A-Za-z]*[A-Za-z].*[ \t][A-Z][a-z]"  # anchored: linear where nothing matches
QUOTED_SIGNALS = [f"^[^{q}]*{q}[^{q}]{{3,}}{q}" for q in ("\"", "'", "`")]
IDENTIFIER_SIGNAL = "[0-9A-Za-z][_/.-][0-9A-Za-z]"
CODE_LINE = f"^[{SPACE_CLASS}]*(?:{'|'.join(re.escape(p) for p in CODE_PREFIXES)})".replace("\\ ", " ").replace("\\#", "#")

PY_SPACE = pattern(SPACE, style="python")
PY_NOT_WORD = pattern(ASCII_OTHER, SPACE, PUNCT, style="python")
SPACE_CHARS = "".join(chr(c) for a, b in SPACE for c in range(a, b + 1))

#: Of each code point below U+10000: 0 other, 1 word, 2 dense, 3 space.  Those above are words.
KIND = np.ones(0x10000, np.uint8)
for _ranges, _kind in ((ASCII_OTHER, 0), (PUNCT, 0), (DENSE, 2), (SPACE, 3)):
    for _a, _b in _ranges:
        KIND[_a : _b + 1] = _kind
