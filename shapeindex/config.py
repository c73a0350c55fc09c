"""Fixed values and option objects.

Values marked FIXED must equal the behaviour being reproduced; everything else is a tunable.
"""
from __future__ import annotations

from dataclasses import dataclass, field


# ---------------------------------------------------------------------------
# FIXED values: structural tokenizer defaults, ranking constants, limits.
# ---------------------------------------------------------------------------
DEFAULT_DROP_FIELD_NAMES = frozenset({"id", "arg", "name"})  # variable, function, class, argument names
DEFAULT_DROP_NODE_NAMES = frozenset({"Module"})  # the root of a file is never a term
DEFAULT_MIN_DEPTH = 4  # a term is a subtree of height >= 4
BM25_K1 = 1.2
BM25_B = 0.75
DEFAULT_TOP_K = 10  # hits per query
PREVIEW_MAX_LINES = 10  # preview block stops once more than this many newlines were emitted
DOCS_URL_MARKER = "docs.python.org"  # hits from the docs keep their url and use the title as filename
DOCS_REPO_NAME = "Python Docs"
SHELL_PROMPTS = (">>>", "...")  # text pieces of a docs snippet starting with these are dropped
INDEX_MAX_BYTES = int(8e9)  # size guard for repository ingestion
# stop words of the title analyzer (the search library's published default list)
TITLE_STOP_WORDS = frozenset({"a", "an", "and", "are", "as", "at", "be", "by", "can", "for", "from", "have",
                              "if", "in", "is", "it", "may", "not", "of", "on", "or", "tbd", "that", "the",
                              "this", "to", "us", "we", "when", "will", "with", "yet", "you", "your"})
REPO_QUERY = {"language": "python", "min_stars": 1, "min_size_kb": 10000, "n": 10}
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class TokenizerOptions:
    """Options of the structural tokenizer (canonical subtree dump)."""

    annotate_fields: bool = True
    include_attributes: bool = False
    drop_field_names: frozenset = DEFAULT_DROP_FIELD_NAMES
    drop_field_values: frozenset = frozenset()
    drop_node_names: frozenset = DEFAULT_DROP_NODE_NAMES
    min_depth: int | None = DEFAULT_MIN_DEPTH
    max_depth: int | None = None

    def __post_init__(self):
        if self.min_depth and self.max_depth:
            assert self.min_depth < self.max_depth, "min_depth must be below max_depth"

    @property
    def uses_text_hash(self) -> bool:
        """Options whose dump depends on more than the subtree's own structure.

        ``max_depth`` truncates relative to the term root, ``drop_field_values`` compares formatted
        text and ``include_attributes`` prints positions; these hash the printed text instead of
        combining child hashes bottom-up.
        """
        return self.max_depth is not None or bool(self.drop_field_values) or self.include_attributes


DEFAULT_OPTIONS = TokenizerOptions()


@dataclass(frozen=True)
class HtmlRules:
    """Selectors for section extraction (class tests are substring tests on the class attribute).

    FIXED values: the defaults are the documentation markup the crawl reads (toc items of class
    ``toctree-l1``; ``div`` sections of class ``section``; headers ``h1``-``h3`` with
    ``headerlink`` anchors; code blocks of class ``highlight-python3``; definitions in ``dl``).
    """

    name: str = "library"
    toc_container: str | None = None  # tag that must enclose toc links (None: any <ul>)
    toc_item_class: str | None = "toctree-l1"  # li class holding a toc link (None: any <a>)
    section_tag: str = "div"
    section_class: str | None = "section"
    header_tags: tuple = ("h1", "h2", "h3")
    code_tag: str = "div"
    code_class: str | None = "highlight-python3"
    headerlink_class: str = "headerlink"
    definitions: bool = True  # parse <dl> definitions (library rules only)
    recursive_toc: bool = True  # library: follow toc links at any depth; tutorial: one level
    shell_prompts: tuple = SHELL_PROMPTS


LIBRARY_RULES = HtmlRules()
TUTORIAL_RULES = HtmlRules(name="tutorial", definitions=False, recursive_toc=False)
# Rules for simple article pages (the driver's ``pages`` table): nav links, one article per page,
# h1 title, paragraphs as text blocks.
ARTICLE_RULES = HtmlRules(name="article", toc_container="nav", toc_item_class=None,
                          section_tag="article", section_class=None, header_tags=("h1",),
                          code_tag="p", code_class=None, definitions=False)


@dataclass(frozen=True)
class SearchOptions:
    k: int = DEFAULT_TOP_K
    root_rule: bool = True  # a matched first term of the file marks every line of the file
    max_lines: int = PREVIEW_MAX_LINES
    broadcast_max_rows: int = 2_000_000  # query-side rows below this are broadcast (checked by count)
    score_digits: int = 6  # scores are rounded before ranking so ties are exact
    prune: bool = True  # exact top-k pruning by per-term score bounds (falls back per query)
    prune_df: int | None = None  # "rare" term df limit; default max(10k, N/1000)
    extra: dict = field(default_factory=dict, compare=False)
