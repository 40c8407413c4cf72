"""The word lists, tables and patterns of the published normalisation and extraction rules."""

from __future__ import annotations

# Units removed by the "string" profile, in order; each is a regular expression.
STRING_UNITS = [
    "degree", "cm", "centimeter", "meter", "mile", "second", "minute", "hour", "week", "month", "year",
    "foot", "feet", "inch", "yard", "p.m.", "PM",
]

# Units removed by the "grade" profile, in order.
GRADE_UNITS = [
    "degree", "cm", "centimeter", "meter", "mile", "second", "minute", "hour", "day", "week", "month", "year",
    "foot", "feet", "inch", "yard",
]

WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

# Powers of ten spelled out.
MAGNITUDES = {"million": "*10^6", "billion": "*10^9", "trillion": "*10^12"}

# Units of the "multilingual" profile; each also occurs with a trailing "s".
MULTILINGUAL_UNITS = [
    "east", "degree", "mph", "kmph", "ft", "m sqaure", " m east", "sq m", "deg", "mile", "q .", "monkey", "prime",
    "ratio", "profit of rs", "rd", "o", "gm", "p . m", "lb", "tile", "per", "dm", "lt", "gain", "ab", "way", "west",
    "a .", "b .", "c .", "d .", "e .", "f .", "g .", "h .", "t", "a", "h", "no change", "men", "soldier", "pie", "bc",
    "excess", "st", "inches", "noon", "percent", "by", "gal", "kmh", "c", "acre", "rise", "a . m", "th", "π r 2", "sq",
    "mark", "l", "toy", "coin", "sq . m", "gallon", "° f", "profit", "minw", "yr", "women", "feet", "am", "pm", "hr",
    "cu cm", "square", "v â € ™", "are", "rupee", "rounds", "cubic", "cc", "mtr", "s", "ohm", "number", "day", "hour",
    "minute", "min", "second", "man", "woman", "sec", "cube", "mt", "sq inch", "mp", "∏ cm ³", "hectare", "more",
    "unit", "cu . m", "cm 2", "rs .", "rs", "kg", "g", "month", "km", "m", "cm", "mm", "apple", "liter", "loss",
    "yard", "pure", "year", "increase", "decrease", "d", "less", "Surface", "litre", "pi sq m", "s .", "metre",
    "meter", "inch",
]

# Number words; zero stays a word.
NUMBER_WORDS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
    "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17,
    "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70,
    "eighty": 80, "ninety": 90,
}
NUMBER_SCALES = {"hundred": 100, "thousand": 1_000, "million": 1_000_000, "billion": 1_000_000_000}

# Symbol map of the "olympiad" profile, in order.
OLYMPIAD_SYMBOLS = [
    (r"\left", ""), (r"\right", ""), ("∶", ":"), ("，", ","), ("$", ""), (r"\approx", "="), (r"\simeq", "="),
    (r"\sim", "="), (r"^\prime", "'"), (r"^{\prime}", "'"), (r"^\circ", ""), ("%", ""),
]
OLYMPIAD_EDGES = "\n$,.:;^_=+`!@#$%^&*~，。"

# Removals of the "symbolic" profile, in order.
SYMBOLIC_REMOVE = [
    "\n", "\t", "approximately", "'", '"', r"\$", "$", "￥", "£", "€", "{,}", r"\!", r"\,", r"\:", r"\;", r"\quad",
    r"\qquad", r"\space", r"\thinspace", r"\medspace", r"\thickspace", "~,", "\\ ", r"\\%", r"\%", "%", r"\left",
    r"\right", r"^{\circ}", r"^\circ",
]

# Replacements of the "symbolic" profile, in order.
SYMBOLIC_REPLACE = [
    ("∪", r"\cup"), ("π", r"\pi"), ("∞", r"\infty"), ("∈", r"\in"), ("∩", r"\cap"), ("−", "-"), (r"\item", ","),
    ("and", ","), (";", ","), ("infinity", r"\infty"), (r"+\infty", r"\infty"), ("tfrac", "frac"), ("dfrac", "frac"),
    (r"\approx", "="), (r"\times", "*"), (r"\cdot", "*"), ("{.", "{0."), (" .", " 0."), (":", "/"),
]

# Formatting commands of the "symbolic" profile, in order.
SYMBOLIC_COMMANDS = [
    r"\textbf", r"\textit", r"\textsl", r"\texttt", r"\textsc", r"\textsf", r"\textrm", r"\mathrm", r"\mathbf",
    r"\mathit", r"\mathsf", r"\mathtt", r"\mathbb", r"\mathcal", r"\mathscr", r"\mathfrak", r"\bm", r"\em", r"\emph",
    r"\underline", r"\overline", r"\tiny", r"\scriptsize", r"\footnotesize", r"\small", r"\normalsize", r"\large",
    r"\Large", r"\LARGE", r"\huge", r"\Huge", r"\newline", r"\par", r"\noindent", r"\indent", r"\footnote", r"\cite",
    r"\ref", r"\label", r"\textsuperscript", r"\textsubscript", r"\text", r"\mbox",
]
SYMBOLIC_ENVIRONMENTS = [
    "align", "align*", "center", "flushleft", "flushright", "itemize", "enumerate", "description",
]

# Units of the "symbolic" profile, in order; each is a regular expression.
SYMBOLIC_UNITS = [
    "hour", "minute", "min", "sec", "second", "day", "week", "month", "year", "meter", "mile", "kg", "mg", "g", "t",
    "ton", "nm", "pm", "um", "μm", "m", "cm", "mm", "dm", "km", "kilometer", "inch", "feet", "piece", "bit", "hz",
    "Hz", "m/s", "km/s", "m/(min^2)", "billion", "eV", "V", "C", "s", "degree", r"a\.?m\.?", r"(?<!\\)p\.?m\.?",
]
FUNCTION_NAMES = "sin|cos|tan|cot|sec|csc|sinh|cosh|tanh|coth|sech|csch|log|ln|exp"
GREEK_NAMES = (
    "alpha|beta|gamma|delta|epsilon|zeta|eta|theta|iota|kappa|lambda|mu|nu|xi|omicron|pi|rho|sigma|tau|upsilon|phi|"
    "chi|psi|omega"
)

# Left sides that merely name the quantity on the right, and both sides of a plus-minus sign.
NAMED_LEFT_SIDE = (
    rf"^([a-z]|[A-Z]{{2}}|\\?({GREEK_NAMES}|{FUNCTION_NAMES}))\^?\{{?-?('|\\prime|\d)*\}}?"
    r"(\(-?([\d\.]+|[a-z])?\))?$"
)
PLUS_MINUS_SIDES = r"([\w\.\\{}\+\-\*\^]+?)(?:\\pm|\\mp)([\w\.\\{}\+\-\*\^]+)"

# Date and time formats, in order, written as Spark patterns.
DATETIME_FORMATS = [
    "yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "yyyy/MM/dd",
    "yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm:ss", "yyyy/MM/dd HH:mm:ss",
    "yyyy-MM-dd HH:mm", "dd/MM/yyyy HH:mm", "MM/dd/yyyy HH:mm", "yyyy/MM/dd HH:mm",
    "HH:mm:ss", "HH:mm", "hh:mm:ss a", "hh:mm a",
]

# Localized "Answer:" markers, in order of trial; each is a regular expression.
ANSWER_MARKERS = [
    r"Answer\s*:", r"উত্তর\s*:", r"उत्तर\s*:", "উত্তরঃ", r"Antwort\s*:", r"답변\s*:", r"정답\s*:", r"답\s*:",
    r"答案\s*：", r"答案\s*:", r"答\s*：", r"答\s*:", r"答复\s*：", r"答曰\s*：", "الإجابة:", "الجواب:", "إجابة:",
    "الإجابة النهائية:", "الإجابة الصحيحة:", "الإجابة الصحيحة هي:", "الإجابة هي:", r"Respuesta\s*:", r"Risposta\s*:",
    r"答え\s*:", r"答え\s*：", r"回答\s*:", r"回答\s*：", r"解答\s*:", r"Jawaban\s*:", r"Réponse\s*:", r"Resposta\s*:",
    r"Jibu\s*:", r"Idahun\s*:", r"Ìdáhùn\s*:", r"Idáhùn\s*:", r"Àmọ̀nà\s*:", r"Àdáhùn\s*:", r"Ànúgọ\s*:", r"Àṣàyàn\s*:",
]
ANSWER_LETTERS = "[A-D]|[أ-د]|[অ]|[ব]|[ড]|[ঢ]|[Ａ]|[Ｂ]|[Ｃ]|[Ｄ]"
LOCAL_LETTERS, LATIN_LETTERS = "أبجدঅবডঢＡＢＣＤ", "ABCDABCDABCD"

# Words ignored when unknown letters are counted, and patterns that rule out evaluation.
KNOWN_WORDS = [
    "sqrt", "frac", "pi", "inf", "cos", "sin", "tan", "cot", "arccos", "arcsin", "arctan", "arccot", "log", "ln", "exp",
]
UNSAFE_TEXTS = ["^{", "^("]
UNSAFE_PATTERNS = [r"\^[0-9]+\^", r"\^-?[0-9][0-9]+", r"\*\*[0-9]+\*\*", r"\*\*-?[0-9][0-9]+", r"[0-9][0-9][0-9]+!"]

# Levels of the multilingual benchmark, lowest first; level i weighs 2^i.
LEVELS = ["low", "middle", "high", "top"]

# Wording rules for labelling a line with an activity, first match wins. They paraphrase the published
# guidelines; the label names are the closed vocabulary.
LABEL_RULES = [  # words and phrases of a rule, and its label
    ("problem|given that|we are asked", "Start Problem"),
    ("definition|is defined|means", "Recall Definition"),
    ("known|identity|recall", "Identify Known Results"),
    ("plan|strategy|approach", "Formulate Strategy"),
    ("formula|rule", "Apply Known Formula"),
    ("simplify|rearrange|expand|factor", "Simplify Expression"),
    ("substitute|substitution|let", "Change of Variable"),
    ("limit|integral|sum", "Evaluate Limit or Integral"),
    ("compare|bound|less|greater", "Perform Comparison"),
    ("theorem|lemma|principle", "Apply Theorem"),
    ("because|since", "Justify Step"),
    ("case|edge|boundary", "Explore Edge Cases"),
    ("contradiction|impossible", "Identify Contradiction"),
    ("interpret|meaning", "Interpret Result"),
    ("check|valid|consistent", "Check Validity"),
    ("example|test", "Verify With Example"),
    ("instead|alternatively|revise", "Refine or Change Strategy"),
    ("therefore|hence|answer|total", "Conclude Final Result"),
    ("original|question", "Recheck Original Question"),
    ("done|finished|end", "End Problem"),
]
