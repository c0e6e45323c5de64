"""Patterns of scientific atoms, as Java's regular expressions."""

import re


def narrowed(chars: str, without: str = "") -> str:
    """A class that takes what [chars] takes, all of it beyond ASCII, but for the characters of without. Java asks each part of a class in turn: this one
    turns the others away by one comparison, and neighbours are one part."""
    codes = {c for a, b, one in re.findall("(.)-(.)|(.)", chars) for c in range(ord(a or one), ord(b or one) + 1)} - set(map(ord, without))
    starts = sorted(c for c in codes if c - 1 not in codes)
    parts = [f"{chr(a)}-{chr(next(c for c in range(a, 0x10000) if c + 1 not in codes))}" for a in starts]
    return f"[{chr(min(codes))}-{chr(max(codes))}&&[{''.join(parts)}]]"



# fixed values: units, symbols, months, word lists and patterns that results must agree on
UNIT = r"(?:dBm|dBc/Hz|dB/Hz|dBc|dB|[GMk]?S/s|[GMk]?b/s|[GMk]?bps|[GMk]?Hz|[fpnumµμkM]?[WVAΩFsH]|[kcmnuµμ]?m(?:[²³]|\^[23])?|ps|ns|µs|μs|ms|s|°[CF]|K|%)"
NUMBER = r"(?:[+−-]?\d+(?:\.\d+)?(?:[eE][+−-]?\d+)?(?:[⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻]+|\^[+−-]?\d+)?)"
QUANTITY = r"(?<![A-Za-z0-9_.])" + NUMBER + r"[ \t  ]*" + UNIT + r"(?![A-Za-z0-9])"
NUMERIC = r"(?<![A-Za-z])(?:\d+(?:\.\d+)?(?:\s*[×xX]\s*10\^?-?\d+)?|\d+(?:\.\d+)?)(?:\s*(?:%|mm²|mm2|µm|um|nm|Gb/s|Gbps|Mb/s|Mbps|kHz|MHz|GHz|dB|mW|µW|uW|V|mV|µV|uV|A|mA|µA|uA|Ω|ohm|°C|K))?(?![A-Za-z])"
#: A number that is taken with the characters around it, for texts whose blanks and separators are doubled (functions.text.numbers_apart): the
#: ends of words and blanks are ASCII's.
NUMERIC_APART = r"(?:^|[^A-Za-z])(" + NUMERIC.removeprefix("(?<![A-Za-z])").removesuffix("(?![A-Za-z])").replace(r"\s", r"[\t\n\f\r ]") + r")(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|[^A-Za-z]|\z)"
CITATION = r"\[\d+(?:\s*[,–-]\s*\d+)*\]|\(\d{4}\)"
FIGURE = r"(?iu)\b(?:Fig\.?|Figure|Table|Eq\.?|Equation)\s*\.?\s*(?:[IVXLC]+|\d+)[A-Za-z]?(?:\([a-z]\))?(?![A-Za-z0-9])"
FIGURE_LOCALISED = r"(?iu)(?:Fig\.?|Figure|图|Table|表|Eq\.?|Equation|式)\s*\.?\s*(?:[IVXLC]+|\d+)[A-Za-z]?(?:\s*[\(（][a-z][\)）])?"
SUBSCRIPT_VARIABLE = r"\b[A-Z][a-z]?(?:_[a-zA-Z0-9±+\-]+)+\b"
SYMBOLS = "α-ωΑ-ΩµμΩÅℏℓ±∓≤≥≠≈≃≅≡≜∞∝∂∇∑∏∫√×⋅·−′″°→←↔⇒⇔∈∉⊂⊆⊃⊇∅∩∪⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎"
SYMBOL = f"[{SYMBOLS}]"
#: Without raised and lowered digits, for Java alone.
SYMBOL_NO_DIGIT = narrowed(SYMBOLS, "⁰¹²³⁴⁵⁶⁷⁸⁹₀₁₂₃₄₅₆₇₈₉")
MONTH = "(?:January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)"
DATE = rf"(?iu)\b{MONTH}\.?\s+\d{{1,2}},?\s+\d{{4}}\b|\b\d{{1,2}}\s+{MONTH}\.?\s+\d{{4}}\b"
BARE_NUMBER = r"(?<![\w.])[+−-]?\d+(?:\.\d+)?(?:[⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻]+|\^[+−-]?\d+)?"
FORMULA_HINT = r"[=≤≥≈∈∑∫√α-ωΑ-Ω∝]|\\frac|\\sum|\\int"
LEFT_SIDE = r"[A-Za-zα-ωΑ-Ω][A-Za-z0-9α-ωΑ-Ω_′″/]*(?:\s*\([^\n=]{1,24}\))?"
MATH_WORDS = ("noise", "power", "gain", "where", "with", "from", "into", "over", "than", "total", "peak", "input", "output", "ratio", "versus", "approx")
SECTION = r"^(?:\d+(?:\.\d+)*\.?\s+|[IVXLC]+\.\s+)[A-Z].+"
CAPTION = r"(?iu)^(?:Fig\.?|Figure|Table)\s*\.?\s*\d+"
INLINE_MATH = r"(?s)(?:[A-Za-zα-ωΑ-Ω][A-Za-z0-9α-ωΑ-Ω_′″]*(?:<(?:sub|sup)>.*?</(?:sub|sup)>)+|[A-Za-zα-ωΑ-Ω]?[α-ωΑ-Ω][A-Za-z0-9α-ωΑ-Ω_′″]*(?:\s*[∝≈=≤≥≠±×·⋅]\s*[^\s,;:，。；]{1,24})|√(?:\([^)]{0,24}\)|[A-Za-zα-ωΑ-Ω_][A-Za-z0-9_]{0,12}))"
SCRIPT_RUN = r"(?s)[A-Za-zα-ωΑ-Ω0-9]*<(?:sub|sup)>.*?</(?:sub|sup)>"
LATEX = r"(?s)\$\$.*?\$\$|\$[^$\n]+\$|\\\(.*?\\\)"
DOI = r"\b10\.\d{4,9}/[^\s<>]+"
LABEL = r"\([a-z]\)"
SCIENTIFIC = r"(?<![\w.])[+−-]?(?:\d+\.\d+|\d+)(?:[eE][+−-]\d+|×\s*10\^?[−-]?\d+|[⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻]+|\^[+−-]?\d+)"
EQUATION_NUMBER = r"\(\d{1,3}[a-z]?\)\s*$"
RADICAND = r"(?iu)^\s*(?:I\s*d\b|I_d\b|I<sub>d</sub>|[A-Za-zα-ωΑ-Ω](?:_[A-Za-z0-9]{1,6}|<(?:sub|sup)>[^<]{1,12}</(?:sub|sup)>))\s*"
OPEN_RELATION = r"[∝≈=≤≥≠±×·⋅]\s*$"
EXTRA_SYMBOLS = "·°×"
TRANSLATABLE = ("title", "abstract", "section", "paragraph", "caption", "table_text", "footnote")
FAILED, ABSORBED = "[翻译失败:", "[MERGED_INTO:"
VISION_MARKERS = ("vl", "vision", "gpt-4o", "gpt-4.1", "gemini", "claude-3", "claude-4", "qwen2.5-vl")
TRANSLATION_ONLY = ("qwen-mt-plus", "qwen-mt-turbo", "alibaba-translate")
# fixed values: words that are no candidates for scripts
STOP_WORDS = (
    "in", "on", "at", "an", "is", "it", "of", "or", "as", "be", "by", "do", "go", "he", "me", "no", "so", "up", "us",
    "we", "if", "to", "am", "ok", "not", "and", "but", "for", "the", "can", "has", "had", "was", "are", "been",
    "from", "that", "this", "with", "will", "would", "could", "should", "all", "any", "its", "let", "may", "nor",
    "own", "per", "via", "yet", "add", "sub", "set", "get", "put", "run", "see", "use", "way", "day", "new", "old",
    "big", "top",
)
GREEK = "αβγδεζηθικλμνξπρστυφχψωΔΩΣ∏∫"
# fixed values: rules of candidates for scripts, in their order: name, pattern, confidence
CANDIDATE_RULES = (
    ("underscore_subscript", r"\b([a-zA-Z]{1,3})_([a-zA-Z0-9]{1,4})\b", 0.95),
    ("single_letter_numeric_sub", r"(?<![a-zA-Z])([a-zA-Z])(\d+)(?![a-zA-Z])", 0.90),
    ("greek_prefix_sub", rf"(?<![a-zA-Z])([{GREEK}])([a-zA-Z0-9]{{1,5}})(?![a-zA-Z])", 0.88),
    ("capital_var_capital_sub", r"(?<![a-zA-Z])([A-Z])([A-Z]{2,3})(?![a-zA-Z])", 0.85),
    ("two_capital_var_sub", r"(?<![a-zA-Z])([A-Z]{2})([A-Z]{1,3})(?![a-zA-Z])", 0.70),
    ("single_letter_lowercase_sub", r"(?<![a-zA-Z])([a-zA-Z])([a-z]{1,4})(?![a-zA-Z])", 0.65),
    ("mixed_case_numeric_sub", r"(?<![a-zA-Z])([a-zA-Z])(\d+[a-zA-Z]{1,3})(?![a-zA-Z])", 0.75),
    ("two_capital_letters", r"(?<![a-zA-Z])([A-Z])([A-Z])(?![a-zA-Z])", 0.55),
    ("numeric_superscript", r"(?<![a-zA-Z_])([a-zA-Z])([²³]|2|3)(?![a-zA-Z0-9])", 0.50),
)
SUPERSCRIPTS, SUPERSCRIPT_TO = "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾", "0123456789+−=()"
SUBSCRIPTS, SUBSCRIPT_TO = "₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎", "0123456789+-=()"
#: Patterns that are masked, and those of segments with their kinds, in order of preference at one place.
MASKS = (LATEX, SCRIPT_RUN, DOI, DATE, QUANTITY, FIGURE, CITATION, LABEL, SUBSCRIPT_VARIABLE, SCIENTIFIC, SYMBOL)
SEGMENTS = (("fig_ref", FIGURE), ("citation", CITATION), ("quantity", QUANTITY), ("quantity", DATE), ("math", SCRIPT_RUN), ("math", INLINE_MATH), ("other", SUBSCRIPT_VARIABLE), ("math", SYMBOL))
#: What every match of a pattern holds one of; "0" stands for a digit, "0000" for four in a row.
NEEDS = {LATEX: ("$", "\\("), SCRIPT_RUN: ("<sub>", "<sup>"), DOI: ("10.",), DATE: ("0000",), QUANTITY: ("0",), CITATION: ("0",), LABEL: ("(",), SUBSCRIPT_VARIABLE: ("_",), SCIENTIFIC: ("0",)}
#: Patterns with the same matches that Java finds sooner: what a match begins with is looked at before words' ends and alternatives are.
QUICK = {SYMBOL: narrowed(SYMBOLS), FIGURE: "(?=[FfTtEe])" + FIGURE, QUANTITY: "(?=[+−0-9-])" + QUANTITY, SCIENTIFIC: "(?=[+−0-9-])" + SCIENTIFIC, NUMERIC: "(?=[0-9])" + NUMERIC, CITATION: r"(?=[\[(])(?:" + CITATION + ")"}
