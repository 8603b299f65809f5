"""Operator 8: license scans by ordered signature rules.

Each rule is a regular expression with a label, a priority and a strength, gated by keywords: one Aho-Corasick
scan of the lower-case text, with single blanks, says which rules run at all. Rules are signatures written by hand
(signatures.py: notices, words of the licenses, identifiers) and names of licenses with their versions. Of the detections, one that
lies within another of the same or a higher priority is suppressed, as is the later rule of two equals that cover the same
interval. Phrases of fixed words are found besides and always stay.

Defined results: a null or empty text has no words, places or labels and the score 0; an empty table gives no rows. Very long texts are
scanned whole, one at a time. Rows repeat as they come, each with its own result. A column of the table that has the name of a result
(n_words, n_base, first_word, last_word, base_labels, labels, score, spans) gives way to it.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm.common import bytes_of, documents, with_arrow
from shelfspark.llm.signatures import EXCEPTIONS, IDENTIFIERS, NOTICES, TEXTS

# Fixed values. Phrases whose words stand one after the other, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Families: label, keywords in lower case of which any match has one, expression of the name (a blank is any white space), versions.
FAMILIES = [
    ("apache", "apache", r"apache(?: software)? licen[sc]e", "1.0 1.1 2.0"),
    ("gpl", "general public", r"(?:gnu )?general public licen[sc]e", "1.0 2.0 3.0"),
    ("lgpl", "lesser general", r"(?:gnu )?lesser general public licen[sc]e", "2.1 3.0"),
    ("lgpl", "library general", r"(?:gnu )?library general public licen[sc]e", "2.0"),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[sc]e", "1.0 3.0"),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation licen[sc]e", "1.1 1.2 1.3"),
    ("mpl", "mozilla", r"mozilla public licen[sc]e", "1.0 1.1 2.0"),
    ("epl", "eclipse", r"eclipse public licen[sc]e", "1.0 2.0"),
    ("eupl", "european union", r"european union public licen[sc]e", "1.0 1.1 1.2"),
    ("cddl", "common development", r"common development and distribution licen[sc]e", "1.0 1.1"),
    ("cpl", "common public", r"common public licen[sc]e", "1.0"),
    ("osl", "open software", r"open software licen[sc]e", "1.0 1.1 2.0 2.1 3.0"),
    ("afl", "academic free", r"academic free licen[sc]e", "1.1 1.2 2.0 2.1 3.0"),
    ("artistic", "artistic", r"artistic licen[sc]e", "1.0 2.0"),
    ("bsl", "boost", r"boost software licen[sc]e", "1.0"),
    ("busl", "business source", r"business source licen[sc]e", "1.0 1.1"),
    ("sspl", "server side", r"server side public licen[sc]e", "1.0"),
    ("elastic", "elastic", r"elastic licen[sc]e", "1.0 2.0"),
    ("ofl", "open font", r"(?:sil )?open font licen[sc]e", "1.0 1.1"),
    ("odbl", "database licen", r"open (?:data commons )?(?:open )?database licen[sc]e", "1.0"),
    ("odc-by", "data commons", r"open data commons attribution licen[sc]e", "1.0"),
    ("psf", "python", r"python software foundation licen[sc]e", "2.0"),
    ("zpl", "zope", r"zope public licen[sc]e", "1.1 2.0 2.1"),
    ("ms-pl", "microsoft public", r"microsoft public licen[sc]e", ""),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal licen[sc]e", ""),
    ("mit", "mit licen", r"mit licen[sc]e", ""),
    ("mit", "expat", r"expat licen[sc]e", ""),
    ("isc", "isc licen", r"isc licen[sc]e", ""),
    ("zlib", "zlib", r"zlib(?:/libpng)? licen[sc]e", ""),
    ("bsd-2-clause", "bsd licen", r"(?:2-clause|simplified|freebsd) bsd licen[sc]e", ""),
    ("bsd-3-clause", "bsd licen", r"(?:3-clause|new|modified|revised) bsd licen[sc]e", ""),
    ("bsd", "bsd", r"bsd(?:-style)? licen[sc]e", ""),
    ("unlicense", "unlicense", r"(?:the )?unlicense", ""),
    ("wtfpl", "wtfpl|want to public", r"wtfpl|do what the fuck you want to public licen[sc]e", "2.0"),
    ("cc0", "cc0|creative commons", r"cc0|creative commons zero", "1.0"),
    ("public-domain", "public domain", r"(?:dedicated to|released into|placed in|in) the public domain", ""),
    ("openssl", "openssl", r"openssl licen[sc]e", ""),
    ("php", "php licen", r"php licen[sc]e", "3.0 3.01"),
    ("w3c", "w3c", r"w3c software (?:notice and )?licen[sc]e", ""),
    ("ncsa", "ncsa", r"(?:university of illinois/)?ncsa open source licen[sc]e", ""),
    ("upl", "universal permissive", r"universal permissive licen[sc]e", "1.0"),
    ("ecl", "educational community", r"educational community licen[sc]e", "1.0 2.0"),
    ("llama", "llama", r"llama (?:[0-9.]+ )?community licen[sc]e", ""),
    ("openrail", "openrail|open rail", r"(?:bigscience |creativeml )?open ?rail(?:-m)?(?: licen[sc]e)?", ""),
]
CC = ["", "-sa", "-nc", "-nd", "-nc-sa", "-nc-nd"]
CC_NAMES = {"": "attribution", "-sa": "share-?alike", "-nc": "non-?commercial", "-nd": "no-?deriv(?:ative)?s?"}
CC_VERSIONS = "1.0 2.0 2.5 3.0 4.0"
SPDX, STATEMENT, VERSIONED, QUOTED, NAMED = 5, 4, 3, 2, 1  # priorities
STRENGTH = {SPDX: 0.99, STATEMENT: 0.95, VERSIONED: 0.9, QUOTED: 0.8, NAMED: 0.6}
PHRASE_STRENGTH = 0.5
GRANT = r"(?:licen[sc]ed|released|distributed|available|published|provided|covered|made available)\s+under\s+(?:the\s+)?(?:terms\s+of\s+)?(?:the\s+)?(?:terms\s+of\s+)?(?:an?\s+|the\s+)?"
#: Between words: white space, which may hold the mark of a comment at the start of a line.
GAP = r"\s+(?:(?:\*|#+|//+|;+)\s+)?"
QUOTE = "[\"'`\u2018\u2019\u201c\u201d]"
_MARK = re.compile(r" (?:\*|#+|//+|;+) ")
#: A machine-readable tag with its expression, as far as that may go, and in an expression the identifiers: at its start or behind an operator.
TAGGED = re.compile(r"(?<![0-9a-z])spdx-license-identifier:\s*+([a-z0-9.+()\x20\t-]*+)")
OPERAND = re.compile(r"(?:^|(?<=[\x20\t])(?:and|or|with)[\x20\t]+)\(*([a-z0-9][a-z0-9.+-]*+)")
CHAR = rb"[0-9a-z\x80-\xff]"  # of a word, in lower case UTF-8


@lru_cache(1)
def rules() -> list[tuple[str, str, int, re.Pattern]]:
    """(label, keywords, priority, expression), highest priority first. A blank of an expression stands for any white space.

    Those of identifiers match one operand of a tagged expression, which identified() hands to them.
    """

    def version(v: str) -> str:
        return r",?[\s-]+(?:version\s+|v\.?\s*)?" + re.escape(v).replace(r"\.0", r"(?:\.0)?") + r"(?![.]?[0-9])"

    out = []
    for label, keyword, name, versions in FAMILIES:
        for v in versions.split():
            full = f"{label}-{v}"
            out += [(full, keyword, STATEMENT, GRANT + f"(?:{name})" + version(v)), (full, keyword, VERSIONED, f"(?:{name})" + version(v))]
            out.append((full, "spdx", SPDX, rf"{re.escape(full)}(?:-only|-or-later|\+)?(?![0-9.])"))
        out += [(label, keyword, STATEMENT, GRANT + f"(?:{name})"), (label, keyword, NAMED, f"(?:{name})")]
        out.append((label, "spdx", SPDX, rf"{re.escape(label)}(?![-0-9.])"))
    for kind in CC:
        short = r"cc[\s-]+by" + kind.replace("-", r"[\s-]+")
        words = r"creative commons\s+" + r"[\s-]+".join(CC_NAMES[x] for x in dict.fromkeys(["", *(f"-{k}" for k in kind.split("-") if k)]))
        for v in CC_VERSIONS.split():
            label, end = f"cc-by{kind}-{v}", r"[\s-]+(?:international\s+|version\s+)?(?:licen[sc]e\s+)?v?" + re.escape(v)
            out += [(label, k, p, g + e + end) for k, e in (("cc", short), ("creative commons", words)) for p, g in ((STATEMENT, GRANT), (VERSIONED, ""))]
            out.append((label, "creativecommons.org", QUOTED, rf"creativecommons\.org/licenses/by{kind}/{re.escape(v)}"))
        out += [(f"cc-by{kind}", k, NAMED, e + r"(?![\s-]+(?:sa|nc|nd)\b)") for k, e in (("cc", short), ("creative commons", words))]
    out += [(label, keyword, STATEMENT, text) for label, keyword, text in NOTICES]
    out += [(label, keyword, QUOTED, text) for label, keyword, text in TEXTS]
    out += [(label, "spdx", SPDX, re.escape(label) + r"(?![-.]?[0-9a-z])") for label in (*IDENTIFIERS, *EXCEPTIONS)]

    def compiled(expression: str) -> re.Pattern:
        before = "(?<![0-9a-z])" if expression[0] != "©" else ""
        return re.compile(f"{before}(?:{expression.replace(' ?', chr(92) + 's*').replace(' ', GAP).replace('~', QUOTE)})")

    return sorted(((label, keywords, priority, compiled(e)) for label, keywords, priority, e in out), key=lambda r: -r[2])


@lru_cache(1)
def _gates() -> tuple[ahocorasick.Automaton, dict[str, list[int]]]:
    by: dict[str, list[int]] = {}
    for i, (_, keywords, _, _) in enumerate(rules()):
        for keyword in keywords.split("|"):
            by.setdefault(keyword, []).append(i)
    machine = ahocorasick.Automaton()
    for keyword in by:
        machine.add_word(keyword, keyword)
    machine.make_automaton()
    return machine, by


def gated(text: str) -> list[int]:
    """Numbers of the rules of which a keyword stands in the text, any gap of which counts as one blank."""
    machine, by = _gates()
    return sorted({i for k in {k for _, k in machine.iter(_MARK.sub(" ", " ".join(text.split())))} for i in by[k]})


def suppressed(found: list[tuple[int, int, str, int, int]]) -> list[tuple[int, int, str, int, int]]:
    """Those of (start, end, label, priority, rule) that lie within no other of the same or a higher priority; of equals, the first rule stays."""
    reach = dict.fromkeys(range(SPDX + 1), -1)  # how far what began before, or with it and longer, reaches, by priority
    kept = []
    for f in sorted(set(found), key=lambda f: (f[0], -f[1], -f[3], f[4])):
        if all(reach[p] < f[1] for p in range(f[3], SPDX + 1)):
            kept.append(f)
        reach[f[3]] = max(reach[f[3]], f[1])
    return kept


@lru_cache(1)
def _identifiers() -> tuple[dict[str, list[int]], int]:
    """Numbers of the rules of identifiers by label, and the longest label."""
    by: dict[str, list[int]] = {}
    for i, (label, _, priority, _) in enumerate(rules()):
        if priority == SPDX:
            by.setdefault(label, []).append(i)
    return by, max(map(len, by))


def identified(text: str) -> list[tuple[int, int, int]]:
    """(start, end, rule) of the identifiers in tagged expressions, each of which is read once, operand by operand, however long it is."""
    by, longest = _identifiers()
    out = []
    for tag in TAGGED.finditer(text):
        for m in OPERAND.finditer(tag[1]):
            start = tag.start(1) + m.start(1)
            for n in range(1, min(len(m[1]), longest) + 1):
                for i in by.get(m[1][:n], ()):
                    hit = rules()[i][3].match(text, start)
                    if hit:
                        out.append((*hit.span(), i))
    return out


def detect(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, label, priority) of the detections that stay, in code points of the lower-case text."""
    found = []
    for i in gated(text):
        label, _, priority, expression = rules()[i]
        if priority != SPDX:
            found += [(*m.span(m.lastindex or 0), label, priority, i) for m in expression.finditer(text)]
    found += [(start, end, rules()[i][0], SPDX, i) for start, end, i in identified(text)]
    return [k[:4] for k in suppressed(found)]


_PHRASES = {label: re.compile(rb"(?<!" + CHAR + rb")" + (rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+").join(w.encode() for w in phrase.split()) + rb"(?!" + CHAR + rb")") for phrase, label in PHRASES.items()}
_FIRST = {label: phrase.split()[-1].encode() for phrase, label in PHRASES.items()}


def word_starts(raw: np.ndarray) -> np.ndarray:
    inside = (raw >= 128) | ((raw >= 48) & (raw <= 57)) | ((raw >= 97) & (raw <= 122))
    return np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))


def scan(data: bytes) -> tuple:
    """n_words, n_base, first_word, last_word, base labels, labels, score and spans of a UTF-8 text."""
    lower = data.lower()  # of bytes: A-Z only
    starts = word_starts(np.frombuffer(lower, np.uint8))
    places = [(m.start(), label) for label, p in _PHRASES.items() if _FIRST[label] in lower for m in p.finditer(lower)]
    spans = detect(lower.decode())
    base = sorted({label for _, label in places})
    at = np.searchsorted(starts, [p for p, _ in places])
    miss = 1.0
    for s in spans:
        miss *= 1 - STRENGTH[s[3]]
    miss *= (1 - PHRASE_STRENGTH) ** len(base)
    return len(starts), len(places), int(at.min()) if places else None, int(at.max()) if places else None, base, sorted({*base, *(s[2] for s in spans)}), round(1 - miss, 6), [{"label": s[2], "start": s[0], "end": s[1]} for s in spans]


def find(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add n_words, n_base, first_word, last_word, base_labels, labels, score and the spans of the rules' detections."""
    strings = T.ArrayType(T.StringType())
    span = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    kinds = {"n_words": T.LongType(), "n_base": T.LongType(), "first_word": T.LongType(), "last_word": T.LongType(), "base_labels": strings, "labels": strings, "score": T.DoubleType(), "spans": span}
    arrow = [pa.int64()] * 4 + [pa.list_(pa.string())] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))]

    def make():
        def compute(batch: pa.RecordBatch):
            raw, offsets = bytes_of(batch, text)
            whole = raw.tobytes()
            rows = [scan(whole[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            return [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(arrow)]

        return compute

    return with_arrow(df, text, [T.StructField(n, k) for n, k in kinds.items()], make, keep)


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find(documents(spark, sf_dir).select("doc_id", "text"), keep=["doc_id"])
    return out.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")}).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


QUERIES = {"op8_licenses": op8_licenses}
ORACLE: dict[str, str] = {}
