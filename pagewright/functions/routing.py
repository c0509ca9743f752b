"""Telling questions about a document as a whole from questions about its content."""

from __future__ import annotations

import difflib
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.functions import text as tx

# ---------------------------------------------------------------------------
# Word lists and patterns that decide the route. The patterns are
# Java regular expressions and are evaluated by Spark only.
# ---------------------------------------------------------------------------
TYPOS = {
    "waht": "what", "wat": "what", "wht": "what", "whta": "what",
    "whats": "what's", "wats": "what's", "whts": "what's",
    "thsi": "this", "ths": "this", "tihs": "this", "taht": "that",
    "abuot": "about", "abotu": "about", "abt": "about", "aboutt": "about",
    "hwo": "how", "hw": "how", "wht's": "what's",
    "doc": "document", "docs": "documents", "docu": "document",
    "documnet": "document", "documet": "document", "doucment": "document",
    "docuemnt": "document", "documnt": "document",
    "sumary": "summary", "summry": "summary", "sumarize": "summarize",
    "sumarise": "summarise", "summerize": "summarize", "summerise": "summarise",
    "summery": "summary", "tldr": "tl;dr", "pls": "please", "plz": "please",
    "u": "you", "ur": "your",
}

VOCABULARY = [
    "document", "documents", "summary", "summaries", "summarize",
    "summarise", "summarization", "overview", "explain", "describe",
    "contents", "structure", "outline", "purpose", "paper", "papers",
    "report", "reports", "article", "articles", "uploaded", "about",
    "pages", "author", "authors", "title", "topic", "topics", "theme",
    "takeaways", "highlights", "synopsis", "abstract", "chapters",
    "sections", "attached", "analyze", "analyse", "mention",
]
SIMILARITY_CUTOFF = 0.84
LONGEST_ROUTED_QUESTION = 400

DOC = (
    "(?:documents?|files?|pdfs?|papers?|reports?|articles?|texts?|uploads?|materials?|books?|resumes?|cvs?|"
    "thesis|theses|manuals?|contracts?|studies|study|policy|policies|presentations?|decks?|essays?|notes|"
    "handouts?|brochures?|pages?|docs?)"
)
DOC_ADJ = "(?:uploaded|attached|whole|entire|full|complete|given|provided|current|indexed|pdf)"
REF_BODY = rf"(?:(?:this|that|the|my|our|these|those|your)\s+)?(?:{DOC_ADJ}\s+)*{DOC}"
PRON = f"(?:{REF_BODY}|this|it|that)"
END = r"\s*[?!.]*\s*$"

SUMMARY_WORD = (
    r"\b(?:summar(?:y|ies|ize|ise|ization|isation|ized|ised)|synopsis|tl;?dr|recap|gist|rundown|run\s?down|"
    r"abstract|overview|digest)\b"
)
BARE = (
    r"^(?:please\s+)?(?:summary|summaries|summarize|summarise|overview|synopsis|tl;?dr|gist|recap|abstract|"
    r"outline|about|title|author|authors|toc|contents|table of contents|structure|topic|topics|pages|length|"
    r"key points|main points|highlights|takeaways|key takeaways)\s*[?!.]*$"
)
ABOUT_TAIL = (
    r"\babout(?:\s+(?:all|exactly|really|actually|overall|in\s+(?:short|brief|general|a\s+nutshell|"
    r"simple\s+terms|a\s+(?:line|sentence|word|nutshell)|one\s+(?:line|sentence)|"
    r"\d+\s+(?:lines?|sentences?|words?|points?|bullets?)))|\s*,?\s*(?:briefly|in\s+short))?\s*[?!.]*\s*$"
)
FOCUS = (
    r"\b(?:of|for|in|on|about|regarding|concerning|related\s+to|from|during)\s+"
    rf"(?!(?:{REF_BODY}|this|it|that|everything|all|these|those|my|our|"
    r"the\s+(?:whole|entire|full|complete|overall)|\d+|one|two|three|four|five|six|"
    r"a\s+(?:few|couple|short|brief|single|nutshell|sentence|paragraph|line|word|bullet)|few|short|brief|"
    r"simple|plain|bullets?|points?|lines?|sentences?|words?|paragraphs?|detail|depth|english|hindi|marathi|"
    r"tamil|telugu|bengali|gujarati|urdu|spanish|french|german|arabic|chinese|japanese|portuguese|russian|"
    r"italian|simple\s+terms)\b)\w"
)
NUMBERED_SCOPE = (
    r"\b(?:sections?|chapters?|parts?|appendix|appendices|clauses?|articles?|slides?|figures?|tables?)"
    r"\s*(?:\d+(?:\.\d+)*|[ivxlc]+)\b|\bpages?\s*\d+\b"
)
SCOPE_NOUN = (
    r"\b(?:section|chapter|paragraph|clause|appendix|table|figure|slide|introduction|conclusion|methodology|"
    r"methods|results|discussion|abstract|foreword|preface|footnote)s?\b"
)
STRUCTURE_WORD = (
    r"\b(?:outline|structure|structured|organi[sz]ation|organi[sz]ed|layout|table\s+of\s+contents|toc|"
    r"headings?|chapters?|sections?|sub-?sections?|topics\s+covered|agenda)\b"
)
DOCUMENT_MENTION = rf"\b{PRON}\b"
STRUCTURE_START = r"^(?:what|which|list|show|give|how many|tell)\b"
IN_OF_THIS = r"\b(?:in|of)\s+(?:this|the|it)\b"
POLITE = r"^(?:(?:please|pls|can you|could you|would you|kindly|just|now|hey|hi|ok|okay)\s+)*"

# Document-level unless what follows the match narrows the question.
SCOPE_SENSITIVE = [
    r"\b(?:main|key|central|core|primary|major|important|principal|overall|big|general|top)\s+"
    r"(?:points?|ideas?|topics?|themes?|takeaways?|messages?|purposes?|objectives?|goals?|aims?|focus|"
    r"subjects?|arguments?|findings?|highlights?|contents?|claims?|conclusions?|insights?|lessons?|"
    r"concepts?|contributions?|outcomes?)\b",
    r"\bhighlights\b",
    r"\btakeaways?\b",
    POLITE + r"(?:explain|describe|analy[sz]e|review|read|examine|break\s+down|walk\s+me\s+through|"
    r"go\s+through|go\s+over|brief\s+me\s+on|help\s+me\s+understand|digest|decode)\b.{0,30}?\b" + PRON + r"\b",
    POLITE + r"give\s+me\s+(?:an?\s+|the\s+)?(?:quick\s+|short\s+|brief\s+|simple\s+|detailed\s+|"
    r"high[- ]level\s+|general\s+|basic\s+|rough\s+)*(?:idea|picture|sense|gist|rundown|understanding|"
    r"introduction|intro|description|explanation|brief|info|information|details)\b",
]

# Document-level in any case.
ALWAYS = [
    # identity
    r"^(?:so\s+|ok\s+|okay\s+)?(?:what|which)(?:\s+(?:is|are|was)|'s)\s+(?:this|that|the|it)"
    rf"(?:\s+(?:uploaded|attached|given|provided|indexed))*(?:\s+{DOC})?{END}",
    # about
    r"\b(?:what|which|who|tell|explain|describe|say|state|is|are|does|do)\b"
    rf".*\b{PRON}\b.*{ABOUT_TAIL}",
    r"\b(?:tell|talk|explain|say|speak|describe|brief|inform|teach)\s+(?:me\s+)?"
    r"(?:something\s+|more\s+|everything\s+|a\s+(?:little|bit)\s+)?(?:about|of)\s+"
    rf"{PRON}(?:\s+in\s+\w+(?:\s+\w+){{0,3}})?{END}",
    rf"\b(?:what|which)\b.{{0,40}}?\b{PRON}\s+(?:contains?|covers?|includes?|discuss(?:es)?|talks?|"
    r"describes?|says?|deals?|focus(?:es)?|presents?|explains?|mentions?|is\s+(?:all\s+)?about|"
    rf"is\s+(?:for|regarding|concerned|related))(?:\s+(?:with|on|about))?{END}",
    rf"\bwhat(?:'s|\s+is|\s+are)\s+(?:\w+\s+){{0,2}}?(?:in|inside|within)\s+{PRON}{END}",
    # kind
    r"\b(?:what|which)\s+(?:kind|type|sort|category|genre|format)\s+of\s+"
    rf"(?:{DOC}|content|text|material)\b",
    rf"\bis\s+(?:this|it|that|{REF_BODY})\s+(?:an?\s+)\w+(?:\s+\w+){{0,2}}{END}",
    rf"\bis\s+(?:this|it|that|{REF_BODY})\s+(?:about|related\s+to|regarding|concerning)\b",
    # purpose
    r"\b(?:purpose|goal|aim|objective|intent|scope|context|background|subject|topic|theme|gist|idea|"
    r"essence|message|focus|summary|overview|outline|structure|contents?)\s+(?:of|behind|for)\s+"
    rf"{PRON}\b",
    r"\bwhat(?:'s|\s+is|\s+are)\s+(?:the\s+)?(?:main\s+|primary\s+|general\s+|overall\s+|core\s+|central\s+)?"
    r"(?:topic|subject|theme|purpose|gist|idea|focus|scope|context|background|contents?|message)s?"
    rf"{END}",
    rf"\bwhy\s+(?:was|is)\s+{PRON}\s+(?:written|made|created|prepared|published|needed|important)\b",
    # audience
    r"\b(?:target|intended|primary)\s+(?:audience|readers?|users?)\b",
    rf"\bwho\s+(?:is|are)\s+{PRON}\s+(?:for|aimed|intended|meant|written\s+for)\b",
    rf"\bwho\s+should\s+read\s+{PRON}\b",
    r"\bwhat\s+(?:do|should|can|could|would)\s+(?:i|you|we)\s+(?:really\s+|actually\s+)?"
    r"(?:need\s+to\s+|have\s+to\s+|want\s+to\s+)?(?:know|learn|understand|get|take|gather|infer)\b"
    rf".{{0,30}}?\b{PRON}\b",
    # title
    rf"\b(?:title|name|heading|headline)\s+(?:of|for)\s+{PRON}\b",
    rf"\bwhat(?:'s|\s+is)\s+(?:the\s+)?(?:title|name){END}",
    rf"\b(?:called|titled|named)\b.{{0,20}}\b{PRON}\b|\b{PRON}\b.{{0,30}}\b(?:called|titled|named)\b",
    r"\bfile\s*name\b",
    # author and date
    r"\bwho\b.{0,20}\b(?:wrote|written|authored|created|prepared|published|compiled|produced|made|issued)\b"
    rf".{{0,30}}\b{PRON}\b",
    r"\bwho\s+(?:is|are|was|were)\s+(?:the\s+)?(?:authors?|writers?|creators?|publishers?)\b",
    rf"\b(?:authors?|writers?)\s+(?:of|for)\s+{PRON}\b",
    r"\b(?:when|what\s+(?:date|year)|which\s+(?:date|year))\b.{0,40}?"
    r"\b(?:written|published|created|made|issued|dated|prepared|released|authored|submitted)\b",
    # size
    r"\bhow\s+many\s+(?:pages?|words?|chunks?|sections?|chapters?)\b",
    rf"\bhow\s+(?:long|big|large|lengthy|extensive)\s+(?:is|was)\s+{PRON}\b",
    r"\b(?:page\s+count|number\s+of\s+pages|word\s+count|total\s+pages)\b",
    # listing and comparison
    r"\b(?:which|what|list|show|how\s+many)\b.{0,20}\b(?:documents?|files?|pdfs?)\b.{0,30}"
    r"\b(?:uploaded|indexed|available|have|loaded|stored|there|do\s+i|in\s+memory)\b",
    r"\bcompare\b.{0,30}\b(?:documents|files|pdfs|papers|reports)\b",
    r"\bdifferences?\s+between\s+(?:the|these|both|my)\s+(?:documents|files|pdfs|papers|reports|two)\b",
]
# ---------------------------------------------------------------------------

_KNOWN = frozenset(VOCABULARY)
_LONG_WORD = re.compile(r"[a-z]{6,}")
_LENGTHS = np.array([len(v) for v in VOCABULARY])
_LETTERS = np.array([[v.count(chr(97 + i)) for i in range(26)] for v in VOCABULARY])


@lru_cache(maxsize=200_000)
def repair_word(word: str) -> str:
    """The closest vocabulary word by gestalt ratio, unless the word is known, nothing is
    close enough, or the two differ only by an ending. Of equally close words the larger wins.

    No ratio can exceed the share of letters two words have in common whatever their order;
    that bound rules out nearly all of the vocabulary at once.
    """
    if word in _KNOWN:
        return word
    letters = np.bincount(np.frombuffer(word.encode(), dtype=np.uint8) - 97, minlength=26)
    bound = 2.0 * np.minimum(_LETTERS, letters).sum(axis=1) / (_LENGTHS + len(word))
    near = [VOCABULARY[i] for i in np.flatnonzero(bound >= SIMILARITY_CUTOFF)]
    scored = [(difflib.SequenceMatcher(None, v, word).ratio(), v) for v in near]
    score, close = max(scored, default=(0.0, ""))
    if score < SIMILARITY_CUTOFF or close.startswith(word) or word.startswith(close):
        return word
    return close


@F.pandas_udf(T.StringType())
def _compose_compatible(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(T.StringType())
def _repair_words(texts: pd.Series) -> pd.Series:
    return texts.map(
        lambda t: None if t is None else _LONG_WORD.sub(lambda m: repair_word(m.group()), t)
    )


def fold_question(question: Column) -> Column:
    """Lower case, plain quotes, no mark-up, single spaces, common typos corrected.

    Compatibility composition has no built-in; only texts beyond ASCII go to Python for it.
    """
    q = F.coalesce(question, F.lit(""))
    beyond_ascii = F.when(q.rlike(r"[^\x00-\x7F]"), q)
    out = F.lower(F.coalesce(_compose_compatible(beyond_ascii), q))
    out = F.translate(out, "’`‘", "'''")
    out = F.regexp_replace(out, r"[*_#>~|]+", " ")
    out = tx.strip(F.regexp_replace(out, r"\s+", " "))
    fixes = F.create_map(*[F.lit(x) for pair in TYPOS.items() for x in pair])
    tokens = F.regexp_extract_all(out, F.lit("[a-z']+|[^a-z']+"), F.lit(0))
    return F.array_join(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(fixes, t), t)), "")


def normalize_question(question: Column) -> Column:
    """``fold_question`` followed by the repair of misspelt long words, which only texts
    with a long word go through."""
    folded = fold_question(question)
    return F.coalesce(_repair_words(F.when(folded.rlike("[a-z]{6}"), folded)), folded)


def _scoped(text: Column) -> Column:
    return text.rlike(FOCUS) | text.rlike(NUMBERED_SCOPE) | text.rlike(SCOPE_NOUN)


def is_document_level(normalized: Column) -> Column:
    """Decide from a normalized question. Long texts are content questions; testing that
    first also keeps the backtracking patterns away from them."""

    def after_first_match(pattern: str) -> Column:
        return F.regexp_replace(normalized, f"(?s)^.*?(?:{pattern})", "")

    decision = F.when(
        (normalized == "") | (tx.utf16_length(normalized) > LONGEST_ROUTED_QUESTION), F.lit(False)
    )
    for pattern in [BARE, *ALWAYS]:
        decision = decision.when(normalized.rlike(pattern), F.lit(True))
    decision = decision.when(normalized.rlike(SUMMARY_WORD) & ~_scoped(normalized), F.lit(True))
    decision = decision.when(
        normalized.rlike(STRUCTURE_WORD)
        & ~normalized.rlike(NUMBERED_SCOPE)
        & (normalized.rlike(DOCUMENT_MENTION) | normalized.rlike(STRUCTURE_START))
        & ~F.regexp_replace(normalized, IN_OF_THIS, "").rlike(FOCUS),
        F.lit(True),
    )
    for pattern in SCOPE_SENSITIVE:
        decision = decision.when(
            normalized.rlike(pattern) & ~_scoped(after_first_match(pattern)), F.lit(True)
        )
    return decision.otherwise(F.lit(False))
