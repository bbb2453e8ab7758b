"""Column expressions for text: cleaning, word tokens, pair transforms, labels.

All are built-in Spark functions (regex, ``translate``, higher-order array
functions), so they run inside codegen and work unchanged on streaming
DataFrames.  Java regex and Python ``re`` agree on the ASCII patterns used here.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievekit.functions._util import col

# Fixed values of the reference's BERT-style pre-tokeniser: besides Unicode
# punctuation (\p{P}), these ASCII symbols are split off as single tokens.
ASCII_SYMBOLS_AS_PUNCT = "$+<=>^`|~"
PUNCT_CLASS = r"[\p{P}" + "$+<=>^`|~" + r"]"
# A word is a run of characters that are not blank (ASCII \s or Unicode
# separators \p{Z}), not control characters and not punctuation.
WORD_PATTERN = PUNCT_CLASS + r"|[^\s\p{Z}\p{Cc}\p{P}" + "$+<=>^`|~" + r"]+"
# The blocks of CJK ideographs, each of which is a word of its own.
CJK = (r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}"
       r"\x{2B820}-\x{2CEAF}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}")
WORD_PATTERN = "[" + CJK + "]|" + WORD_PATTERN.replace(r"\p{Cc}", r"\p{Cc}" + CJK)
# Control and format characters (blanks aside) vanish before words are cut.
VANISHING = r"[\p{Cc}\p{Cf}\x{FFFD}&&[^\t\n\r]]"
MASK_TOKEN = "[MASK]"
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"  # Python string.punctuation


def _ws_trim(c: Column) -> Column:
    """Python ``str.strip()`` on ASCII whitespace (Spark ``trim`` strips blanks only)."""
    return F.regexp_replace(F.regexp_replace(c, r"^\s+", ""), r"\s+$", "")


def clean_mentions(text) -> Column:
    """Remove ``[USER]``/``[URL]`` markers (``\\]*`` = any number of ``]``) and
    surrounding whitespace in three passes, stripping after each."""
    t = col(text)
    t = _ws_trim(F.regexp_replace(t, r"\[USER\]*\s*", ""))
    t = _ws_trim(F.regexp_replace(t, r"\[URL\]*\s*", ""))
    t = _ws_trim(F.regexp_replace(t, r"\[USER\]*\s*\[URL\]*", ""))
    return t


def extract_numeric_id(s) -> Column:
    """Last run of digits (``sexism2022_english-3523`` → ``3523``)."""
    return F.element_at(F.regexp_extract_all(col(s), F.lit(r"\d+"), 0), -1)


def parse_label(s) -> Column:
    """``LABEL_k`` → k: the text after the first ``_`` as int."""
    c = col(s)
    return F.substring(c, F.instr(c, "_") + 1, 1 << 30).cast("int")


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str]:
    """Rule-built ``translate`` table: every precomposed letter of any script whose NFD
    form is one base letter plus non-spacing marks maps to that base letter."""
    src, dst = [], []
    for cp in range(0x00C0, 0x10000):
        ch = chr(cp)
        if not unicodedata.decomposition(ch) or unicodedata.decomposition(ch).startswith("<"):
            continue
        base = "".join(c for c in unicodedata.normalize("NFD", ch) if unicodedata.category(c) != "Mn")
        if len(base) == 1 and base != ch:
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst)


def strip_accents(text) -> Column:
    """Accent strip (NFD, drop non-spacing marks) for every script: a
    ``translate`` table plus removal of free combining marks — JVM-side."""
    s, d = _accent_table()
    return F.regexp_replace(F.translate(col(text), s, d), r"\p{Mn}+", "")


def tokens_basic(text) -> Column:
    """Word-level tokens of the reference's tokenizer: drop control and format
    characters, lower-case, strip accents, split on whitespace; every
    punctuation mark and every CJK ideograph is its own token.  NULL text → no
    tokens."""
    t = F.lower(strip_accents(F.regexp_replace(F.coalesce(col(text), F.lit("")), VANISHING, "")))
    return F.regexp_extract_all(t, F.lit(WORD_PATTERN), 0)


def words(text) -> Column:
    """Whitespace tokens (no normalisation)."""
    return F.filter(F.split(col(text), r"\s+"), lambda w: w != "")


def pair_to_text(premise, hypothesis) -> Column:
    return F.concat(F.lit("PREMISE: "), col(premise), F.lit(" HYPOTHESIS: "), col(hypothesis))


def hypothesis_only(hypothesis) -> Column:
    return F.concat(F.lit("HYPOTHESIS: "), col(hypothesis))


def premise_only(premise) -> Column:
    return F.concat(F.lit("PREMISE: "), col(premise))


def overlap_share(h_tokens, p_tokens) -> Column:
    """Share of hypothesis tokens (duplicates counted) found in the premise."""
    h, p = col(h_tokens), col(p_tokens)
    hit = F.size(F.filter(h, lambda t: F.array_contains(p, t)))
    return F.try_divide(hit.cast("double"), F.size(h).cast("double"))


def overlap_band(h_tokens, p_tokens) -> Column:
    """``HIGH/MEDIUM/LOW/NO OVERLAP.`` at 0.75 / 0.5 / 0.25."""
    o = overlap_share(h_tokens, p_tokens)
    band = (F.when(o >= 0.75, "HIGH").when(o >= 0.5, "MEDIUM").when(o >= 0.25, "LOW")
            .otherwise("NO"))
    return F.concat(band, F.lit(" OVERLAP."))


def raw_overlap_mask(tokens, other_tokens, mask: str = MASK_TOKEN) -> Column:
    """Keep tokens present in both sides (set intersection), mask the rest,
    joined by blanks."""
    a, b = col(tokens), col(other_tokens)
    return F.array_join(F.transform(a, lambda t: F.when(F.array_contains(b, t), t)
                                    .otherwise(F.lit(mask))), " ")


def shuffle_tokens(tokens, seed, key) -> Column:
    """Reproducible token shuffle: sort positions by ``md5(seed|key|pos|token)``
    (``F.shuffle`` is random per run and has no oracle)."""
    t = col(tokens)
    tagged = F.transform(t, lambda x, i: F.struct(
        F.md5(F.concat_ws("|", F.lit(str(seed)), col(key).cast("string"), i.cast("string"), x)).alias("h"),
        x.alias("t")))
    return F.transform(F.array_sort(tagged), lambda s: s["t"])


def length_mask(tokens) -> Column:
    """Every token replaced by ``#``."""
    return F.array_join(F.transform(col(tokens), lambda _: F.lit("#")), " ")


def lexicon_pattern(lexicon: list[str]) -> str:
    """Regex that matches every word *not* in the lexicon (case-insensitive)."""
    import re
    alts = "|".join(re.escape(w) for w in lexicon)
    return r"(?iU)(?!\b(" + alts + r")\b)\b[^ ]+\b"


def keep_lexicon_words(text, lexicon: list[str]) -> Column:
    """Delete every word not in ``lexicon``, drop ASCII punctuation, strip;
    an empty result becomes ``" "`` (the null input)."""
    t = F.regexp_replace(col(text), lexicon_pattern(lexicon), "")
    t = _ws_trim(F.translate(t, ASCII_PUNCTUATION, ""))
    return F.when(t == "", F.lit(" ")).otherwise(t)


def sentiment_label(polarity) -> Column:
    """neutral in [-0.10, 0.10], positive above, negative below."""
    p = col(polarity)
    return (F.when((p >= -0.10) & (p <= 0.10), "neutral").when(p > 0.10, "positive")
            .otherwise("negative"))


def clean_token(tok) -> Column:
    """Byte-pair marker ``Ġ`` → ``_``."""
    return F.translate(col(tok), "Ġ", "_")


def drop_special_tokens(ids) -> Column:
    """Drop the first and last id (``[CLS]`` … ``[SEP]``)."""
    a = col(ids)
    return F.slice(a, 2, F.greatest(F.size(a) - 2, F.lit(0)))


def concat_positions(len_a, len_b) -> Column:
    """Position ids for ``a ++ b``: 0..la-1 then la..la+lb-1."""
    la, lb = col(len_a), col(len_b)
    n = la + lb
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).when(n == 0, F.array().cast("array<int>"))


def type_from_label(label, positive_name: str, other_name: str, positive=1) -> Column:
    return F.when(col(label) == F.lit(positive), positive_name).otherwise(other_name)


def display_name(key) -> Column:
    """``a_b`` → ``A b``: first letter upper-cased, underscores to blanks."""
    k = F.regexp_replace(col(key), "_", " ")
    return F.concat(F.upper(F.substring(k, 1, 1)), F.substring(k, 2, 1 << 30))
