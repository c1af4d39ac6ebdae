"""Fixed word lists and patterns for text operators."""

from __future__ import annotations

# Word characters as Python's \w sees them (letters and numbers of any script, underscore).
WORD_CHARS = r"\p{L}\p{N}_"
WORD = r"[\p{L}\p{N}_]+"

# Emoji code-point ranges removed from text, in order.
EMOJI_RANGES = (
    (0x1F600, 0x1F64F),
    (0x1F300, 0x1F5FF),
    (0x1F680, 0x1F6FF),
    (0x1F1E0, 0x1F1FF),
    (0x2702, 0x27B0),
    (0x24C2, 0x1F251),
)
EMOJI = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in EMOJI_RANGES) + "]+"

# English stop words (the customary short list; contractions are omitted because
# punctuation is stripped before the words are compared).
STOPWORDS_EN = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers "
    "herself it its itself they them their theirs themselves what which who whom this that these those am is are "
    "was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out "
    "on off over under again further then once here there when where why how all any both each few more most other "
    "some such no nor not only own same so than too very s t can will just don should now d ll m o re ve y ain "
    "aren couldn didn doesn hadn hasn haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn"
).split()

# Words that mark a question as being about data.
DATA_KEYWORDS = [
    "data", "analy", "statistic", "model", "predict", "visualiz", "clean", "process", "machine learning", "ai",
    "dataset", "pandas", "numpy", "excel", "csv", "json", "sql", "table", "column", "row", "feature", "target",
    "regress", "classif", "cluster", "plot", "chart", "graph", "correlat", "missing", "outlier", "normaliz",
    "standardiz", "etl", "transform", "analyze", "insight", "trend", "pattern", "business intelligence",
    "dashboard", "report", "query",
]  # phrases that start with "data" or "big data" are implied by "data"

# Default polarity of opinion words.
POLARITY_EN = {
    **dict.fromkeys(
        "good great excellent amazing wonderful best better love loved like liked happy helpful fast easy nice "
        "perfect recommend pleasant reliable clear useful enjoy enjoyed fantastic superb positive win".split(),
        1.0,
    ),
    **dict.fromkeys(
        "bad terrible awful worst worse hate hated dislike sad slow hard poor broken fail failed failure useless "
        "unclear boring annoying angry disappointing disappointed wrong problem negative loss".split(),
        -1.0,
    ),
}

# Entity patterns, tried independently of each other.
ENTITY_PATTERNS = {
    "DATE": r"[0-9]{4}-[0-9]{2}-[0-9]{2}",
    "EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "MONEY": r"[$€£][0-9]+(?:[.,][0-9]+)*",
    "NAME": r"[A-Z][a-z]+(?: [A-Z][a-z]+)+",
    "PERCENT": r"[0-9]+(?:\.[0-9]+)?%",
    "URL": r"https?://[A-Za-z0-9./?=&_%#:-]+",
}
