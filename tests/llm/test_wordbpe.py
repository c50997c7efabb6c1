"""The ids are the tokenizer's own."""

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from plantflow.llm.packing import tokenizer_path
from plantflow.llm.wordbpe import WordBpe

ODD = ["", " ", "it's '' !!'s ''re 'LLama we'VE 'd'm", "Ça ÉTÉ ÀÿÞß ×÷ naïve", "<|endoftext|> a<|b", "ﬁ Ⅷ é Σίσυφος ΟΔΟΣ İ 漢字 x y", "a\x0bb\x0cc\x1cd\x85e 12a34", "'", "x'", "'s", "²³ ª º µ"]


def ids_of(texts):
    flat, counts = WordBpe.at(tokenizer_path()).ids(pa.array(texts, pa.string()))
    out, at = [], 0
    for n in counts.tolist():
        out.append(flat[at : at + n].tolist())
        at += n
    return out


def check(texts):
    own = WordBpe.at(tokenizer_path()).tokenizer
    assert ids_of(texts) == [own.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_odd_texts():
    check([*ODD, None, "".join(map(chr, range(1, 128))), " ".join(map(chr, range(1, 300)))])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aAsStTdDmMlLrReEvV'\"!?. \n\t09éÉßÜñ|<>_-"), max_size=40), max_size=5))
def test_against_tokenizer(texts):
    check(texts)
