"""Licence scan with ordered signature rules.

Every rule is a regular expression over the text's words (lower case, one space between). One pass of an automaton finds the
keywords of all rules in a text, and a rule is tried only where its keyword stands; most texts hold none. Detections are taken in order
of rule priority, then length; one whose interval lies inside an accepted one is suppressed, so "apache license
version 2.0" is not reported again as "apache license". Rules are signatures of licence texts and notices
(``license_texts``), and names, versions, tags and addresses of the licence families below; several hundred in all.

A text is handled where its row is: nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents, small_batches
from .license_texts import SIGNATURES
from .text_kernel import buffers, word_spans

# The phrases that every scan must count, and their labels.
BASE_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Licence families. label: (names, versions, SPDX identifiers, web addresses)
FAMILIES: dict[str, tuple[list[str], list[str], list[str], list[str]]] = {
    "gpl": (["gnu general public licen[sc]e", "gnu gpl", "gplv?"], ["1", "2", "3"], ["gpl-1.0", "gpl-2.0", "gpl-3.0"], ["gnu.org/licenses/gpl"]),
    "lgpl": (["gnu lesser general public licen[sc]e", "gnu library general public licen[sc]e", "gnu lgpl", "lgplv?"], ["2", "2.1", "3"], ["lgpl-2.0", "lgpl-2.1", "lgpl-3.0"], ["gnu.org/licenses/lgpl"]),
    "agpl": (["gnu affero general public licen[sc]e", "gnu agpl", "agplv?"], ["1", "3"], ["agpl-1.0", "agpl-3.0"], ["gnu.org/licenses/agpl"]),
    "gfdl": (["gnu free documentation licen[sc]e", "gfdl"], ["1.1", "1.2", "1.3"], ["gfdl-1.1", "gfdl-1.2", "gfdl-1.3"], ["gnu.org/licenses/fdl"]),
    "apache": (["apache software licen[sc]e", "apache licen[sc]e", "asl"], ["1.0", "1.1", "2.0"], ["apache-1.0", "apache-1.1", "apache-2.0"], ["apache.org/licenses/license-2.0"]),
    "mit": (["mit licen[sc]e", "expat licen[sc]e", "mit/x11 licen[sc]e"], [], ["mit"], ["opensource.org/licenses/mit"]),
    "bsd": (["bsd licen[sc]e", "bsd style licen[sc]e", "berkeley software distribution licen[sc]e", "bsd"], ["2 clause", "3 clause", "4 clause"], ["bsd-2-clause", "bsd-3-clause", "bsd-4-clause"], ["opensource.org/licenses/bsd"]),
    "isc": (["isc licen[sc]e", "internet systems consortium licen[sc]e"], [], ["isc"], ["opensource.org/licenses/isc"]),
    "zlib": (["zlib licen[sc]e", "zlib/libpng licen[sc]e"], [], ["zlib"], ["opensource.org/licenses/zlib"]),
    "mpl": (["mozilla public licen[sc]e", "mpl"], ["1.0", "1.1", "2.0"], ["mpl-1.0", "mpl-1.1", "mpl-2.0"], ["mozilla.org/mpl"]),
    "epl": (["eclipse public licen[sc]e", "epl"], ["1.0", "2.0"], ["epl-1.0", "epl-2.0"], ["eclipse.org/legal/epl"]),
    "cddl": (["common development and distribution licen[sc]e", "cddl"], ["1.0", "1.1"], ["cddl-1.0", "cddl-1.1"], ["opensource.org/licenses/cddl"]),
    "eupl": (["european union public licen[sc]e", "eupl"], ["1.0", "1.1", "1.2"], ["eupl-1.0", "eupl-1.1", "eupl-1.2"], ["joinup.ec.europa.eu"]),
    "artistic": (["artistic licen[sc]e"], ["1.0", "2.0"], ["artistic-1.0", "artistic-2.0"], ["opensource.org/licenses/artistic"]),
    "boost": (["boost software licen[sc]e", "bsl"], ["1.0"], ["bsl-1.0"], ["boost.org/license"]),
    "unlicense": (["the unlicense"], [], ["unlicense"], ["unlicense.org"]),
    "wtfpl": (["do what the fuck you want to public licen[sc]e", "wtfpl"], ["2"], ["wtfpl"], ["wtfpl.net"]),
    "public-domain": (["public domain dedication", "dedicated to the public domain", "released into the public domain"], [], [], []),
    "cc0": (["creative commons zero", "cc0"], ["1.0"], ["cc0-1.0"], ["creativecommons.org/publicdomain/zero"]),
    "odbl": (["open database licen[sc]e", "odbl"], ["1.0"], ["odbl-1.0"], ["opendatacommons.org/licenses/odbl"]),
    "ofl": (["sil open font licen[sc]e", "open font licen[sc]e"], ["1.0", "1.1"], ["ofl-1.0", "ofl-1.1"], ["scripts.sil.org/ofl"]),
    "php": (["php licen[sc]e"], ["3.0", "3.01"], ["php-3.0", "php-3.01"], ["php.net/license"]),
    "python": (["python software foundation licen[sc]e", "psf licen[sc]e"], ["2"], ["psf-2.0", "python-2.0"], ["docs.python.org/license"]),
    "openssl": (["openssl licen[sc]e"], [], ["openssl"], ["openssl.org/source/license"]),
    "ms-pl": (["microsoft public licen[sc]e"], [], ["ms-pl"], ["opensource.org/licenses/ms-pl"]),
    "ms-rl": (["microsoft reciprocal licen[sc]e"], [], ["ms-rl"], ["opensource.org/licenses/ms-rl"]),
    "proprietary": (["all rights reserved", "proprietary and confidential"], [], [], []),
}
# The Creative Commons kinds, their words, and their versions.
CC_KINDS = {"cc-by": "attribution", "cc-by-sa": "attribution share ?alike", "cc-by-nd": "attribution no ?deriv(?:ative)?s?(?: works)?", "cc-by-nc": "attribution non ?commercial", "cc-by-nc-sa": "attribution non ?commercial share ?alike", "cc-by-nc-nd": "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"}
CC_VERSIONS = ["1.0", "2.0", "2.5", "3.0", "4.0"]
LEAD = r"(?:licen[sc]ed|released|distributed|published|available|redistributed|provided|covered) (?:to you )?under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?"
#: A licence that is only mentioned to be ruled out.
DENIAL = re.compile(rb"(?:not|never|longer|isn t|aren t) (?:be )?(?:licen[sc]ed |released |distributed |available )?(?:under )?(?:the |a |an )?$")
FORMS = {"notice": (0, 0.95), "text": (1, 0.95), "tag": (2, 0.98), "address": (3, 0.9), "title": (4, 0.8), "name": (5, 0.6)}


@dataclass(frozen=True)
class Rule:
    label: str
    form: str
    keyword: str
    pattern: re.Pattern[bytes]

    @property
    def priority(self) -> int:
        return FORMS[self.form][0]


def _spoken(text: str) -> str:
    """An identifier or address as the words that the scan sees."""
    return " ".join(re.findall(r"[0-9a-z]+", text.lower()))


def rules() -> list[Rule]:
    """All rules, by priority and then by label."""
    out: list[tuple[str, str, str, str]] = []
    for label, (names, versions, tags, addresses) in FAMILIES.items():
        for name in names:
            loose = name.replace("/", " ?").replace("-", " ?")
            keyword = re.split(r"\[|v\?|/", name)[0]
            for version in versions:
                number = version.replace(".", " ?") if "clause" not in version else version
                numbered = rf"{number} {loose}" if "clause" in version else rf"{loose}(?: licen[sc]e)?(?: (?:version|v))? ?v?{number}(?: 0)?"
                exact = f"{label}-{version.replace(' ', '-')}"
                out.append((exact, "notice", keyword, LEAD + numbered))
                out.append((exact, "title", keyword, numbered))
            out.append((label, "notice", keyword, LEAD + loose))
            out.append((label, "name", keyword, loose))
        out += [(tag, "tag", "spdx license identifier", rf"spdx license identifier {_spoken(tag)}(?: only| or later)?") for tag in tags]
        out += [(label, "address", _spoken(x), _spoken(x)) for x in addresses]
    for label, words in CC_KINDS.items():
        short, long = label.replace("-", " "), rf"creative commons {words}(?: (?:international|unported|generic))?(?: (?:public )?licen[sc]e)?(?: version)?"
        for version in CC_VERSIONS:
            number = version.replace(".", " ")
            named = lambda x, number=number: f"{x} {number}"
            for keyword, words_of in (("creative commons", long), (short, short)):
                out.append((f"{label}-{version}", "notice", keyword, LEAD + named(words_of)))
                out.append((f"{label}-{version}", "title", keyword, named(words_of)))
            out.append((f"{label}-{version}", "tag", "spdx license identifier", rf"spdx license identifier {short} {number}"))
            out.append((f"{label}-{version}", "address", "creativecommons org licenses", rf"creativecommons org licenses {short[3:]} {number}"))
        out += [(label, "name", "creative commons", f"creative commons {words}"), (label, "name", short, short)]
    out += [(label, "text", keyword, pattern) for label, keyword, pattern in SIGNATURES]
    made = [Rule(label, form, keyword, re.compile(rb"(?<![^ ])" + pattern.encode() + rb"(?![^ ])")) for label, form, keyword, pattern in out]
    return sorted(made, key=lambda r: (r.priority, r.label))


GAP = np.ones(256, bool)
GAP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
FOLD = bytes(32 if GAP[i] else i + 32 if 65 <= i <= 90 else i for i in range(256))


def gate(table: list[Rule]):  # noqa: ANN201
    """The automaton of all keywords, each with the places of its rules in the table; base phrases have none."""
    import ahocorasick

    places: dict[str, list[int]] = {f" {phrase} ": [] for phrase in BASE_PHRASES}
    for i, rule in enumerate(table):
        places.setdefault(rule.keyword, []).append(i)
    found = ahocorasick.Automaton()
    for keyword, some in places.items():
        found.add_word(keyword, (keyword, some))
    found.make_automaton()
    return found


def open_rules(words: bytes, automaton) -> list[int] | None:  # noqa: ANN001
    """The places of the rules whose keywords a text holds, ascending; None where it holds no keyword and no base phrase."""
    seen: dict[str, list[int]] = {}
    for _, (keyword, some) in automaton.iter(f" {words.decode('latin-1')} "):
        seen[keyword] = some
    return sorted({i for some in seen.values() for i in some}) if seen else None


def standing(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """The detections that no better one contains: in order of priority, length and place each is accepted unless its interval lies in
    an accepted one. A tree of the furthest ends, by start, answers that in logarithmic time."""
    found = sorted(found, key=lambda x: (x[2].priority, x[0] - x[1], x[0], x[2].label))
    starts = {a: i for i, a in enumerate(sorted({a for a, _, _ in found}), 1)}
    furthest = [-1] * (len(starts) + 1)
    stand = []
    for a, b, rule in found:
        i, reach = starts[a], -1
        while i:
            reach, i = max(reach, furthest[i]), i & (i - 1)
        if reach >= b:
            continue
        stand.append((a, b, rule))
        i = starts[a]
        while i < len(furthest):
            furthest[i] = max(furthest[i], b)
            i += i & -i
    return sorted(stand, key=lambda x: (x[0], x[1], x[2].label))


def detections(words: bytes, table: list[Rule], wanted: list[int] | None = None) -> list[tuple[int, int, Rule]]:
    """The detections that stand, in order of place. words: joined by single spaces; wanted: the rules to try, by place in the table."""
    found = []
    for rule in table if wanted is None else (table[i] for i in wanted):
        for m in rule.pattern.finditer(words):
            if not DENIAL.search(words, max(0, m.start() - 60), m.start()):
                found.append((m.start(), m.end(), rule))
    return standing(found)


def word_borders(words: bytes) -> np.ndarray:
    return np.flatnonzero(np.frombuffer(words, np.uint8) == 32)


def base_places(words: bytes) -> list[tuple[int, str]]:
    """All places (in words) where a base phrase stands, with its label."""
    whole, out = b" " + words + b" ", []
    spaces = word_borders(whole)
    for phrase, label in BASE_PHRASES.items():
        target, at = b" " + phrase.encode() + b" ", -1
        while (at := whole.find(target, at + 1)) >= 0:
            out.append((int(np.searchsorted(spaces, at)), label))
    return sorted(out)


SHAPE = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, found array<struct<label:string,rule:string,first_word:long,end_word:long>>"


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, found.

    score: 1 minus the product of (1 - weight of the form) over the detections, so 0 where there is none. Null and
    empty texts: no words, no labels. Repeated rows are scanned each for itself; ties between rules of the same
    priority and length go to the earlier place, then to the smaller label.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rules()
        automaton = gate(table)
        kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("rule", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64())]))]
        for batch in batches:
            raw, off = buffers(batch.column(1))
            n_words = np.diff(word_spans(raw, off, GAP)[2])
            whole = raw.tobytes().translate(FOLD)
            out: list[list] = [[] for _ in range(9)]
            for doc_id, n, a, b in zip(batch.column(0).to_pylist(), n_words.tolist(), off[:-1].tolist(), off[1:].tolist(), strict=True):
                places, stand = [], []
                words = b" ".join(whole[a:b].split())
                if (wanted := open_rules(words, automaton)) is not None:
                    places, stand = base_places(words), detections(words, table, wanted)
                borders, missing = word_borders(words) if stand else None, 1.0
                for _, _, rule in stand:
                    missing *= 1 - FORMS[rule.form][1]
                for _ in places if not stand else ():
                    missing *= 0.5
                base = sorted({x for _, x in places})
                row = (doc_id, n, len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(base), ",".join(sorted({*base, *(r.label for _, _, r in stand)})), 1 - missing)
                for column, value in zip(out, (*row, [{"label": r.label, "rule": r.form, "first_word": int(np.searchsorted(borders, s)), "end_word": int(np.searchsorted(borders, e)) + 1} for s, e, r in stand]), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "found"])

    small_batches(docs.sparkSession)
    return documents(docs).mapInArrow(run, SHAPE)
