"""Patterns and word lists that fix results. Java syntax; (?i) where case does not count."""

# The patterns below are part of the rules' definition.
FORMULA_MARKED = (
    r"(?i)(?:"
    r"\\[a-zA-Z]+|"
    r"\$\$[\s\S]+?\$\$|"
    r"\$[^$\n]{1,300}\$|"
    r"\\\[[\s\S]+?\\\]|"
    r"\\\(.+?\\\)|\b(?:\\\(|\\\))|"
    r"\b[a-zA-Z]_(?:\{[^{}]+\}|[a-zA-Z0-9]\b)|(?<=[\)\}\]])_(?:\{[^{}]+\}|[a-zA-Z0-9]\b)|"
    r"\b[a-zA-Z]\^(?:\{[^{}]+\}|[a-zA-Z0-9\*\+⊤⊥\-]\b)|(?<=[\)\}\]])\^(?:\{[^{}]+\}|[a-zA-Z0-9\*\+⊤⊥\-]\b)|"
    r"[∑∫∏∂∇√αβγδεζηθικλμνξοπρστυφχψωΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ≤≥≠≈≡≢∈∉∀∃⊂⊃⊆⊇∪∩∼∝⊤⊥∠∧∨⊕⊗⊙⊘⊚⊢⊣⊨⊩⊪⋅⋆°′″‴…⋮⋯⋱≜≝≐≒≓≔≕]|"
    r"[ℝℤℕℚℂ𝔼ℙℒℋℱ𝒟]|"
    r":=|≔|≜|"
    r"(?<![A-Za-z0-9_,\(\)\{\}\[\]\^])[A-Za-z0-9_,\(\)\{\}\[\]\^]+\s*(?:=|≈|~|:=|≔|≤|<=|≥|>=)\s*(?:E\s*[\[(]|\\sum|\\int|\\prod|tr\b|[0-9A-Za-z_\\\(])"
    r")"
)
FORMULA_WORDS = (
    r"(?i)(?:"
    r"\bcoloneqq\b|\btriangleq\b|"
    r"\b(?:tr|Cov|Var|argmax|argmin|arg\s*max|arg\s*min|diag|det|sup|inf|log|exp|softmax|sigmoid|ReLU|GeLU)\s*[\(\[_]|"
    r"\b(?:Theorem|Lemma|Proposition|Corollary|Axiom)\s+\d+[:.]|"
    r"\b(?:mod|pmod)\s+[0-9a-zA-Z]+|\bcongruent\s+to\s+[0-9a-zA-Z]+|"
    r"\b(?:quasiconvex|quasi-convex|Lipschitz|Hessian|eigenvalue|eigenvector|spectral\s+bound)\b"
    r")"
)
URL = r"(?i)https?://[^\s<>\"']+"
CURRENCY = r"(?i)(?<!\\)\$\d+(?:,\d{3})*(?:\.\d+)?(?:\s*(?:million|billion|trillion|k|M|B)\b)?"
WEAK_SYMBOLS = ["′", "″", "∼", "×", "⋅", "°", "…"]
REFERENCE_TITLE = (
    r"(?:references?|bibliography|works\s+cited|literature\s+cited|"
    r"further\s+reading|selected\s+references|bibliographic\s+notes|"
    r"acknowledg(?:e)?ments?|author\s+contributions?|competing\s+interests?|"
    r"funding|conflict\s+of\s+interests?|declarations?|data\s+availability|"
    r"code\s+availability|broader\s+impacts?|checklist|"
    r"reproducibility\s*statement|ethics\s*statement|ethical\s+considerations|"
    r"ai\s*use\s*statement|ai\s*disclosure|appendix\s*contents|table\s*of\s*contents)"
)
PROSE_GUARD = (
    r"(?i)\b(?:"
    r"we\s+(?:propose|introduce|present|show|demonstrate|evaluate|define|observe|find|use|train|develop|analyze|study|derive|formulate|ablate|investigate|compare|report|measure|test|conduct|construct|design)|"
    r"our\s+(?:method|approach|model|framework|experiments|results|analysis|algorithm|architecture|study|findings|benchmark)|"
    r"this\s+(?:section|chapter|paper|appendix|table|figure)\s+(?:presents|describes|shows|details|reports|evaluates|introduces|investigates|analyzes)|"
    r"in\s+this\s+(?:section|chapter|paper|work|study|appendix)|"
    r"theorem\s+\d|lemma\s+\d|proposition\s+\d|corollary\s+\d|definition\s+\d"
    r")\b"
)
GOVERNANCE = (
    r"(?is)(?:"
    r"^(?:\d+(?:\.\d+)*\s+)?(?:acknowledg(?:e)?ments?|ethics\s*statement|ethical\s+considerations|reproducibility\s*statement|ai\s*use\s*statement|ai\s*disclosure|broader\s+impacts?|funding|competing\s+interests?)\b|"
    r"\backnowledge\s+support\s+from\b|\bsupported\s+in\s+part\s+by\s+grant\b|\bcontributed\s+equally\s+to\s+this\s+work\b|"
    r"\bno\s+additional\s+ethical\s+concerns\b|\bofficial\s+policies\s+or\s+endorsements\s+of\b|"
    r"\bneither\s+the\s+european\s+union\s+nor\b|\bvaluable\s+comments\s+on\s+an\s+earlier\s+draft\b|"
    r"\bAnswer:\s*\[(?:Yes|No|NA)\]\s*\n\s*Justification:\s*See\b"
    r")"
)
TOC_DOTS = r"(?i)(?:(?:\.\s+){4,}\.|\.{5,}|(?:^|\n)\s*(?:APPENDIX\s*CONTENTS|TABLE\s*OF\s*CONTENTS)\b)"
CITATION_BRACKET = r"\[\d{1,3}\]"
DOI = r"(?i)\b(?:doi(?::|\.org/)|10\.\d{4,9}/[-._;()/:A-Za-z0-9]+)\b"
ARXIV_ID = r"(?i)\barXiv:\d{4}\.\d{4,5}(?:v\d+)?\b"
VENUE = (
    r"(?i)(?:\b(?:"
    r"In\s*Proceedings\s+of|In\s*Proceedings|Proceedings\s+of|In\s*Findings\s+of|In\s*Advances\s+in|"
    r"Conference\s+on|Symposium\s+on|IEEE\s+Transactions|ACM\s+Transactions|"
    r"Transactions\s+on\s+Machine\s+Learning\s+Research|Journal\s+of\s+[A-Z][a-z]+|"
    r"Association\s+for\s+Computational\s+Linguistics|arXiv\s+preprint|"
    r"NeurIPS|ICML|ICLR|CVPR|ECCV|ICCV|ACL|EMNLP|NAACL|KDD|AAAI|SIGIR|IJCAI|PMLR|JMLR|"
    r"MIT\s+Press|Oxford\s+University\s+Press|Curran\s+Associates|OpenReview\.net|"
    r"ISSN\s+\d{4}-\d{4}|ISBN\s+[\d\-]+|"
    r"vol\.\s*\d+|volume\s+\d+|no\.\s*\d+|pp\.\s*\d+[–\-—]+\d+|pages\s+\d+[–\-—]+\d+"
    r")\b|"
    r"https?://(?:arxiv\.org|openreview\.net|aclanthology\.org|doi\.org|proceedings\.mlr\.press|proceedings\.iclr\.cc)|\b\d+\(\d+\):\d+[–\-—]+\d+)"
)
BIB_LINE = r"(?m)^[ \t]*(?:\[\d{1,3}\]|\d{1,3}\.\s+[A-Z]|[A-Z][a-zA-Z´'\-]+,\s+[A-Z]\.|\b(?:et\s+al\.|ed\.|eds\.)\b)"
AUTHOR_TOKEN = r"\b[A-Z][a-zA-Z´'\-]+(?:\s+[A-Z]\.|\s+[A-Z][a-zA-Z´'\-]+)?,"
CODE_HEADER = r"(?i)(?:#include\s+<[a-z0-9_./]+>|#define\s+[A-Z0-9_]+|#ifndef\s+[A-Z0-9_]+|#endif)"
LICENSE = r"(?i)(?:All\s+rights\s+reserved|GNU\s+General\s+Public\s+License|Apache\s+License,\s+Version|Permission\s+is\s+hereby\s+granted,\s+free\s+of\s+charge|MIT\s+License|Creative\s+Commons\s+Attribution)"
SCRAPE_NOISE = r"(?i)(?:Posted\s+by\s*[:\w]+|Reply\s+with\s+quote|Join\s+Date\s*:\s*\w+|Posts\s*:\s*\d+|Location\s*:\s*\w+)"
AFFILIATION = r"(?i)(?:\bCorrespondence\s+to:|\b1\s*[A-Z][a-zA-Z\s,]+(?:University|Institute|Center|College|Laboratory)\b)"
TOKENIZER_NOISE = r"(?i)@-@|@\.@|<unk>"
PROMPT_SCHEMA = (
    r"(?i)(?:^<\|im_start\|>|<\|im_start\|>[\s\S]*?<\|im_end\|>|<curr_prompt>|\"zero_overlap_verified\":\s*true|"
    r"\binstruction\s*:\s*\.\.\.\.?,?\s*output\s*:\s*\.\.\.)"
)
SUBFIGURES = r"(?is)^\([a-d]\)\s+[A-Z].*?\([b-e]\)\s+[A-Z]"
SIGNPOST = (
    r"(?is)(?:\bAll\s+proofs\s+are\s+provided\s+in\s+Appendix\b|"
    r"\bPlot\s+conventions\s+appear\s+in\s+Appendix\b|"
    r"\bTables?\s+\d+[–\-—]?\d*\s+list\s+the\b.*?\bbehind\s+Figures?\b|"
    r"\b(?:are\s+provided\s+in|appear\s+in|can\s+be\s+found\s+in)\s+Appendix\s+[A-Z0-9.\-]+)"
)
CAPTION = r"(?i)^(?:Figure|Fig\.|Table|Tab\.|Listing)\s*\d+[:.]"
CAPTION_VERBS = r"(?i)\b(?:shows?|demonstrates?|illustrates?|compares?|presents?|reports?|reveals?|indicates?|outperforms?|achieves?|improves?)\b"
CHECKMARKS = r"(?:[×✓✗✔✘]\s*){4,}"
CALLOUTS = r"(?s)(?:^|\n)\s*01\s+[A-Z][a-z]+.*?\s+02\s+[A-Z][a-z]+.*?\s+03\s+[A-Z][a-z]+.*?\s+04\s+[A-Z][a-z]+"
ARXIV_AUTHORS = r"(?s)arXiv:\d{4}\.\d{4,5}.*?[A-Z][a-z]+"
PROCEEDINGS_SLICE = r"(?is)^(?:In\s*Proceedings|In\s*Findings|In\s*Advances|Proceedings\s+of)\b.*?(?:pages|pp\.)\s*\d+[–\-—]+\d+"
REFERENCES_TURN = r"(?:^|\n|\.\s+)(?:References|REFERENCES|Bibliography|BIBLIOGRAPHY)\s*\n"
CITATION_TAIL = r"(?i)^(?:In\s*Proceedings|In\s*Findings|In\s*Advances|Proceedings\s+of|Association\s+for|Asso-\s*ciation\s+for|volume\s+\d+|vol\.\s*\d+|pages\s+\d+|pp\.\s*\d+|\d+\s*[–\-—]\s*\d+|doi:|URL\s*https?://)"
LINKS = r"(?i)https?://\S+|doi:\s*\S+|arXiv:\s*\S+|\b\d+\(\d+\):\d+"
YEAR = r"\b(?:19|20)\d{2}[a-z]?\b"
NUMBERED_AUTHOR = r"(?:^\s*\[\d{1,3}\]|(?:^|\n)\s*\d{1,3}\.\s+[A-Z][a-zA-Z\-]+,\s*[A-Z]\.)"
SURVEY_TITLE = r"(?i)^(?:appendix:?\s*)?(?:survey\s+questionnaire|raw\s+questionnaire|survey\s+items)$"
QUESTION_ITEM = r"(?i)(?:Question|Item)\s+\d+[:.]"
OPTION_ITEM = r"(?i)\bOption\s+[A-D][:.]"
TABLE_RULE = r"^\|?[\s:-]+\|[\s:|-]+$"
CODE_WORDS = r"\b(def|class|return|for\s+.*\s+in|while|if\s+.*:)\b"
INLINE_REFERENCES = r"(?:^|\n)\s*(?:References|REFERENCES|Bibliography|BIBLIOGRAPHY|Works\s+Cited|Literature\s+Cited)\s*(?:\n|$)"
APPENDIX_EXIT = r"(?:^|\n|\.\s+)(?:Appendix|APPENDIX|Supplementary|SUPPLEMENTARY|[A-Z]\.\s+[A-Z]|[A-Z]\.\d+\s+[A-Z]|S\d+\s+[A-Z]|[A-Z]\s+[A-Z]{2,})"
APPENDIX_TITLE = r"(?i)(?:^|\b)(?:appendix|supplementary|annex)\b"
PAGES_TITLE = r"(?i)^pages?\s+\d+"
SECTION_SPLIT = r"(?i)(?:^|\n)(?=#{1,3}\s+[^\n]+|(?:Chapter|Глава|Section|Part|Act)\s+[\dIVXLCDM]+[^\n]*)"
HEADING = r"(?m)^(#{1,6})\s+(.+)$"
DISPLAY_MATH = r"(?s)(?:\$\$(.+?)\$\$|\\\[(.+?)\\\]|\\begin\{(?:equation\*?|align\*?|gather\*?|multline\*?)\}(.+?)\\end\{(?:equation\*?|align\*?|gather\*?|multline\*?)\})"
INLINE_MATH = r"(?:\$([^\$\n]{3,250})\$|\\\(([^\)\n]{3,250})\\\))"
EQUATION_LINE = r"(?m)^[ \t]*([\w,\(\)\{\}\\\^\*\[\]\s\-]{1,50}\s*(?:=|\\approx|\\sim|\\le|\\ge|<=|>=|==|≤|≥|≠|≈|∼|∝|∈)\s*.{3,300})[ \t]*$"
MATH_SYMBOL = r"(?:\\[a-zA-Z]+|[_\^][a-zA-Z0-9{}]|[=≤≥≠≈∼∝∈∉∀∃∑∫∏∂∇√αβγδεθλμστφχψωΓΔΘΛΞΠΣΥΦΨΩ]|\b(?:tr|Cov|Var|argmax|argmin|diag|det)\b|\bE\s*[\[(])"
RELATIONS = ["=", "\\approx", "\\sim", "\\le", "\\ge", "≤", "≥", "≠", "≈", "∼", "∝", "∈", "==", "<=", ">="]
ABBREVIATION = r"(?i)\b(mr|mrs|ms|dr|prof|sr|jr|vs|etc|e\.g|i\.e|inc|ltd|co|corp|al|vol|no|fig|st|dept|approx|est)\.\s*$"
SENTENCE_END = r"""(?<=[.!?])\s+|(?<=[.!?]["'”’\)])\s+"""

# Word lists.
GROUNDING_STOP_WORDS = [
    "and", "are", "the", "for", "with", "not", "but", "all", "any", "can",
    "had", "has", "was", "one", "our", "out", "you", "this", "that", "from",
    "they", "been", "have", "were", "into", "more", "some", "such", "than",
]
NAME_STOP_WORDS = ["the", "a", "an", "and", "or", "of", "in", "to", "for", "with", "on", "at", "by", "from", "as", "is", "are"]
OPPOSITES = [
    ("attack", "defense"), ("attacker", "defender"), ("offensive", "defensive"), ("retreat", "advance"), ("centralized", "decentralized"),
    ("static", "dynamic"), ("positive", "negative"), ("synchronous", "asynchronous"), ("supervised", "unsupervised"), ("deterministic", "stochastic"),
    ("symmetric", "asymmetric"), ("linear", "nonlinear"), ("discrete", "continuous"), ("inbound", "outbound"), ("ingress", "egress"),
]
MONTHS = {
    "jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3, "apr": 4, "april": 4, "may": 5, "jun": 6, "june": 6, "jul": 7, "july": 7,
    "aug": 8, "august": 8, "sep": 9, "sept": 9, "september": 9, "oct": 10, "october": 10, "nov": 11, "november": 11, "dec": 12, "december": 12,
}
QUESTION_PREFIXES = [
    r"^what\s+is\s+a\s+", r"^what\s+is\s+an\s+", r"^what\s+is\s+the\s+", r"^what\s+is\s+", r"^what\s+are\s+the\s+", r"^what\s+are\s+", r"^how\s+does\s+",
    r"^how\s+do\s+", r"^tell\s+me\s+about\s+", r"^explain\s+", r"^describe\s+", r"^definition\s+of\s+", r"^define\s+", r"^overview\s+of\s+",
]
GENERIC_CONCEPTS = [
    "definition", "definitions", "example", "examples", "concept", "concepts",
    "description", "plot details", "plot", "plots", "interpretation", "interpretations",
    "specifics", "comparison", "comparisons", "details", "role", "roles",
    "title", "titles", "author", "authors", "book reference", "reference document",
    "summary", "overview", "introduction", "conclusion", "method", "methodology",
    "principle", "principles", "pattern", "patterns", "model", "models",
    "figure", "table", "section", "chapter", "page", "result", "results",
    "performance", "metric", "metrics", "measurement", "measurements",
    "analysis", "evaluation", "evaluations", "approach", "framework",
    "study", "paper", "article", "task", "tasks", "data", "dataset",
]
