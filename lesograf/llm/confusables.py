"""One form for text that looks the same: confusables skeleton.

decompose (canonically) -> replace every character by the prototype of its look-alikes -> decompose
again; texts with equal skeletons look the same. The prototype of a letter is its look-alike in one
target script, so that case can be set aside afterwards: Latin ``B`` looks like Cyrillic ``В`` and
then stands for ``в``, in a Latin word for ``b``.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lesograf.sources.tables import broadcast_if_small

# Letters of the same shape. Each line: Latin, Cyrillic, Greek; "-" where there is none.
LOOK_ALIKES = """
a а -
c с ϲ
d ԁ -
e е -
g ԍ -
h һ -
i і ι
j ј ϳ
k к κ
l ӏ -
o о ο
p р ρ
q ԛ -
s ѕ -
v ѵ ν
w ԝ -
x х χ
y у -
A А Α
B В Β
C С Ϲ
E Е Ε
F - Ϝ
G Ԍ -
H Н Η
I І Ι
J Ј Ϳ
K К Κ
M М Μ
N - Ν
O О Ο
P Р Ρ
Q Ԛ -
S Ѕ -
T Т Τ
V Ѵ -
W Ԝ -
X Х Χ
Y У Υ
Z - Ζ
- Г Γ
- П Π
- Ф Φ
"""
# Signs of the same shape.
SAME_SIGN = {"‐": "-", "‑": "-", "ʼ": "’"}

TO_SCRIPT: dict[str, dict[int, str]] = {"latin": {}, "cyrillic": {}}
for _line in LOOK_ALIKES.split("\n"):
    if _line:
        _latin, _cyrillic, _greek = _line.split()
        for _script, _own in (("latin", _latin), ("cyrillic", _cyrillic)):
            if _own != "-":
                for _c in (_latin, _cyrillic, _greek):
                    if _c not in ("-", _own):
                        TO_SCRIPT[_script][ord(_c)] = _own
for _table in TO_SCRIPT.values():
    _table.update({ord(a): b for a, b in SAME_SIGN.items()})

_CYRILLIC = re.compile("[Ѐ-ԯ]")
_LATIN = re.compile("[A-Za-zÀ-ɏ]")


def visible(text: str) -> str:
    """Canonical decomposition without what has no width; any blank is a plain one; wide forms plain."""
    out = []
    for ch in unicodedata.normalize("NFD", text):
        o = ord(ch)
        if o < 0x2000 and o not in (0xA0, 0xAD, 0x34F, 0x115F, 0x1160, 0x1680, 0x180E):
            out.append(ch if o != 9 and o != 10 and o != 13 else " ")
        elif o == 0x34F or 0x115F <= o <= 0x1160 or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF or unicodedata.category(ch) == "Cf":
            continue
        elif unicodedata.category(ch) == "Zs":
            out.append(" ")
        elif 0xFF01 <= o <= 0xFF5E:  # the wide forms of ASCII follow its order
            out.append(chr(o - 0xFEE0))
        else:
            out.append(ch)
    return "".join(out)


def skeleton(text: str, script: str) -> str:
    """The text in the look-alikes of ``script``, case set aside."""
    s = visible(text).translate(TO_SCRIPT[script])
    return unicodedata.normalize("NFD", unicodedata.normalize("NFC", s).lower()).strip()


def script_of(form: str) -> str:
    return "cyrillic" if _CYRILLIC.search(form) else "latin"


def clean_form(text: str | None) -> str | None:
    """One form for comparisons: invisible characters gone, composed, letters of the word's main
    script, lower case. Whatever can be seen (stress marks, dots, repeated letters) stays."""
    if text is None:
        return None
    s = unicodedata.normalize("NFC", visible(text)).strip()
    # letters that only one script has decide; without any, the more frequent script
    own = {k: sum(1 for c in s if r.match(c) and ord(c) not in TO_SCRIPT[other]) for k, r, other in (("cyrillic", _CYRILLIC, "latin"), ("latin", _LATIN, "cyrillic"))}
    if own["cyrillic"] == own["latin"]:
        own = {"cyrillic": len(_CYRILLIC.findall(s)), "latin": len(_LATIN.findall(s))}
    script = "cyrillic" if own["cyrillic"] >= own["latin"] and own["cyrillic"] else "latin"
    return unicodedata.normalize("NFC", skeleton(text, script))


def _skeletons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo: dict[str, tuple[str, str]] = {}
    for batch in batches:
        encoded = pc.dictionary_encode(batch.column("text"))
        pairs = []
        for t in encoded.dictionary.to_pylist():
            if (p := memo.get(t)) is None:
                if len(memo) > 200_000:
                    memo.clear()
                p = memo[t] = (skeleton(t, "cyrillic"), skeleton(t, "latin"))
            pairs.append(p)
        columns = [pa.array([p[k] for p in pairs], pa.string()).take(encoded.indices) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([batch.column("tok_key"), *columns], names=["tok_key", "cyrillic", "latin"])


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        encoded = pc.dictionary_encode(batch.column("text"))
        forms = pa.array([clean_form(t) for t in encoded.dictionary.to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns, forms.take(encoded.indices)], names=[*batch.schema.names, "form"])


def normal_tokens(tokens: DataFrame) -> DataFrame:
    """``tok_key, text, char_start, char_end, form`` of every row: ``form`` compares equal for texts
    that look the same, the offsets still point at the stored text. NULL text gives NULL; empty text
    gives an empty form; repeated rows stay."""
    rows = tokens.select("tok_key", "text", "char_start", "char_end")
    return rows.mapInArrow(_clean, "tok_key bigint, text string, char_start int, char_end int, form string")


@F.pandas_udf(StringType())
def _form_skeleton(form: pd.Series) -> pd.Series:
    return form.map(lambda f: None if f is None else skeleton(f, script_of(f)))


def form_script(form: Column) -> Column:
    return F.when(form.rlike("[\\u0400-\\u052f]"), "cyrillic").otherwise("latin")


def look_alikes(tokens: DataFrame, forms: DataFrame, max_forms: int = 500_000) -> DataFrame:
    """``tok_key, form_id`` of tokens that are no form (case aside) but look exactly like one.

    A token that looks like a form of either script gives one row for each. NULL and empty texts and
    forms give none; repeated rows give one row each. The forms are broadcast up to ``max_forms``
    rows and joined by shuffle beyond.
    """
    forms = broadcast_if_small(forms.where("form IS NOT NULL").select("form_id", F.lower("form").alias("form")), max_forms)
    rest = tokens.where("text IS NOT NULL AND tok_key IS NOT NULL").select("tok_key", "text")
    rest = rest.where(F.col("text").rlike("[\\p{L}\\p{N}]")).join(forms.select("form"), F.lower("text") == F.col("form"), "left_anti")
    keyed = rest.mapInArrow(_skeletons, "tok_key bigint, cyrillic string, latin string")
    table = forms.select("form_id", _form_skeleton("form").alias("skeleton"), form_script(F.col("form")).alias("script"))
    table = broadcast_if_small(table, max_forms)
    each = keyed.select("tok_key", F.explode(F.array(*(F.struct(F.lit(s).alias("script"), F.col(s).alias("skeleton")) for s in ("cyrillic", "latin")))).alias("k"))
    return each.select("tok_key", "k.script", "k.skeleton").join(table, ["script", "skeleton"]).select("tok_key", "form_id")
