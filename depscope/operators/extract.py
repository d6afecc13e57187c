"""Import statements of source files as edges.

One projection per file. A scan of the text by one pattern per language takes comments and literals as whole
tokens, in the order in which they open, and leaves code only; a short plain string stays where a language names
imports by strings. Then the language picks a set of expressions, each of which yields an array of targets. Loops of the
patterns are possessive, so they run without a stack and do not go back. Nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from depscope.functions.paths import extension

# Language of a file extension.
IMPORT_LANGUAGES = {
    "go": "go", "py": "python", "ts": "typescript", "tsx": "typescript", "rs": "rust",
    "js": "javascript", "jsx": "javascript", "java": "java", "c": "c",
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hxx": "cpp", "rb": "ruby",
}
# Classification also reads C headers and ignores the case of an extension.
CLASSIFIED_LANGUAGES = {**IMPORT_LANGUAGES, "h": "c"}

# Import statements, one pattern per form, on code without comments and foreign literals.
GO_BLOCK = r"(?m)(?:^|(?<=;))[ \t]*import[ \t]*\(([^)]*)\)"
GO_QUOTED = r'"([^"\n]+)"'
GO_SINGLE = r'(?m)(?:^|(?<=;))[ \t]*import[ \t]+(?:[\w.]+[ \t]+)?"([^"\n]+)"'
PYTHON_FROM = r"(?m)(?:^|[;:])[ \t]*from[ \t]+(\S+)[ \t]+import\b"
PYTHON_IMPORT = r"(?m)(?:^|[;:])[ \t]*import[ \t]+([^#;\n]+)"
# Only names in braces may stand on several lines.
JS_IMPORT = r"""(?m)(?:^|(?<=;))[ \t]*import\b\s*(?:[^'"();\n]*(?:\{[^{}'"();]*\}[^'"();\n]*)?\s*\bfrom\s*)?['"]([^'"\n]+)['"]"""
JS_REQUIRE = r"""\brequire\([ \t]*['"]([^'"\n]+)['"][ \t]*\)"""
RUST_USE = r"(?m)(?:^|(?<=[;{}]))[ \t]*(?:pub(?:\([^)\n]*\))?[ \t]+)?use\s+([^;]+);"
RUST_EXTERN = r"(?m)(?:^|(?<=[;{}]))[ \t]*(?:pub[ \t]+)?extern[ \t]+crate[ \t]+(\w+)"
JAVA_IMPORT = r"(?m)(?:^|(?<=;))[ \t]*import\s+([^;\n]+);"
C_QUOTED = r'(?m)^[ \t]*#[ \t]*include[ \t]*"([^"\n]+)"'
C_SYSTEM = r"(?m)^[ \t]*#[ \t]*include[ \t]*<([^>\n]+)>"
RUBY_REQUIRE = r"""(?m)^[ \t]*require[ \t]+['"]([^'"\n]+)['"]"""
RUBY_RELATIVE = r"""(?m)^[ \t]*require_relative[ \t]+['"]([^'"\n]+)['"]"""

# Tokens. Plain strings can name an import: no escapes, and nothing in them that ends a statement or opens a call.
_PLAIN_DOUBLE, _PLAIN_SINGLE = r'"[^"\\\n;`()\']*+"', r"""'[^'\\\n;`()"]*+'"""
_DOUBLE, _SINGLE = r'"[^"\\\n]*+(?:\\[\s\S][^"\\\n]*+)*+"', r"'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+'"
_CHARACTER = r"'(?:[^'\\\n]|\\[^\n'][^'\n]*+|\\')'"
_LONG_DOUBLE = r'"""(?:[^"\\]++|\\[\s\S]|"(?!""))*+"""'
_LONG_SINGLE = r"""\'\'\'(?:[^'\\]++|\\[\s\S]|'(?!''))*+\'\'\'"""
_BLOCK = r"/\*(?:[^*]++|\*(?!/))*+\*/"
_LINE, _HASH = r"//[^\n]*+", r"#[^\n]*+"
_BACKQUOTED = r"`[^`]*+`"


def _nested(open_: str, close: str, plain: str, depth: int) -> str:
    """Pattern of text between marks that may hold itself, `depth` times over; `plain` is one piece without marks."""
    inner = f"{open_}(?:{plain})*+{close}"
    for _ in range(depth):
        inner = f"{open_}(?:{plain}|{inner})*+{close}"
    return inner


# Block comments within one another, and expressions in template literals that hold braces, strings and templates.
_RUST_BLOCK = _nested(r"/\*", r"\*/", r"[^*/]++|\*(?!/)|/(?!\*)", 6)
_RUST_RAW = r'\bb?r(?<hashes>#*+)"(?:(?!"\k<hashes>)[\s\S])*+"\k<hashes>'
_RUST_STRING = r'"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"'
_CPP_RAW = r'\bR"(?<mark>[^()\\\s"]{0,16})\((?:(?!\)\k<mark>")[\s\S])*+\)\k<mark>"'
_BRACES = _nested(r"\{", r"\}", rf"[^{{}}`'\"/]++|/(?![/*])|{_DOUBLE}|{_SINGLE}|{_BLOCK}|{_LINE}|`(?:[^`\\$]++|\\[\s\S]|\$(?!\{{))*+`", 4)
_TEMPLATE = rf"`(?:[^`\\$]++|\\[\s\S]|\$(?!\{{)|\${_BRACES})*+`"
_RUBY_BLOCK = r"^=begin\b[\s\S]*?(?:^=end\b[^\n]*+|\z)"
_RUBY_REST = r"^__END__$[\s\S]*+"
_RUBY_HERE = r"<<[~-]?(?<quote>['\"]?)(?<name>[A-Z_]\w*+)\k<quote>[^\n]*+\n(?:(?!^[ \t]*\k<name>$)[^\n]*+\n)*+[ \t]*\k<name>$"


def code_only(language: Column, text: Column) -> Column:
    """The text without comments, line continuations and literals, but for plain strings of languages that import by them."""
    def scan(kept: str | None, *gone: str) -> Column:
        return F.regexp_replace(text, "(?m)" + "|".join([f"({kept})" if kept else "(?!)()", *gone]), "$1")

    slashes = (_BLOCK, _LINE)
    return (
        F.when(language == "python", F.regexp_replace(scan(None, _LONG_DOUBLE, _LONG_SINGLE, _DOUBLE, _SINGLE, _HASH), r"\\\r?\n", " "))
        .when(language == "java", scan(None, _LONG_DOUBLE, _DOUBLE, _CHARACTER, *slashes))
        .when(language == "rust", scan(None, _RUST_RAW, _RUST_STRING, _CHARACTER, _RUST_BLOCK, _LINE))
        .when(language == "go", scan(_PLAIN_DOUBLE, _DOUBLE, _CHARACTER, _BACKQUOTED, *slashes))
        .when(language == "ruby", scan(f"{_PLAIN_DOUBLE}|{_PLAIN_SINGLE}", _DOUBLE, _SINGLE, _RUBY_BLOCK, _RUBY_REST, _RUBY_HERE, _HASH))
        .when(language.isin("c", "cpp"), scan(_PLAIN_DOUBLE, _CPP_RAW, _DOUBLE, _CHARACTER, *slashes))
        .otherwise(scan(f"{_PLAIN_DOUBLE}|{_PLAIN_SINGLE}", _DOUBLE, _SINGLE, _TEMPLATE, *slashes))
    )


def may_import(language: Column, text: Column) -> Column:
    """Whether a text has a word without which it cannot import anything; most work is spared by it."""
    return (
        F.when(language == "rust", text.contains("use") | text.contains("extern"))
        .when(language.isin("c", "cpp"), text.contains("include"))
        .when(language == "ruby", text.contains("require"))
        .otherwise(text.contains("import") | text.contains("require"))
    )


def language_of(path: Column, languages: dict[str, str] = IMPORT_LANGUAGES, ignore_case: bool = False) -> Column:
    """Language by file extension, null if there is none."""
    ext = F.lower(extension(path)) if ignore_case else extension(path)
    # A constant map: the extension is taken once, however many languages there are.
    table = F.create_map(*[F.lit(text) for pair in languages.items() for text in pair])
    return F.try_element_at(table, ext)


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def _prefixed(names: Column, prefix: str) -> Column:
    return F.transform(names, lambda n: F.concat(F.lit(prefix), n))


def _go(text: Column) -> Column:
    in_blocks = F.flatten(F.transform(_all(text, GO_BLOCK), lambda block: _all(block, GO_QUOTED)))
    return F.transform(
        F.concat(in_blocks, _all(text, GO_SINGLE)),
        lambda p: F.concat(F.when(p.contains("."), "pkg:").otherwise("std:"), p),
    )


def _python(text: Column) -> Column:
    listed = F.flatten(F.transform(_all(text, PYTHON_IMPORT), lambda names: F.split(names, ",")))
    modules = F.transform(listed, lambda part: F.regexp_extract(part, r"^\s*(\S*)", 1))
    return _prefixed(F.filter(F.concat(_all(text, PYTHON_FROM), modules), lambda m: m != ""), "pkg:")


def _javascript(text: Column) -> Column:
    return F.transform(
        F.concat(_all(text, JS_IMPORT), _all(text, JS_REQUIRE)),
        lambda p: F.concat(F.when(p.startswith(".") | p.startswith("/"), "local:").otherwise("pkg:"), p),
    )


def _rust(text: Column) -> Column:
    def crates(tree: Column) -> Column:
        # What lies behind `::{` does not name a crate. Most trees have no braces.
        bare = tree
        for _ in range(6):
            bare = F.regexp_replace(bare, r"::\s*\{[^{}]*\}", "")
        bare = F.regexp_replace(bare, r"^\s*(?:::)?\s*\{|\}\s*$", "")
        items = F.split(F.when(tree.contains("{") | tree.contains("}"), bare).otherwise(tree), ",")
        return F.array_distinct(F.transform(items, lambda x: F.regexp_extract(x, r"^\s*(?:::)?\s*(?:r#)?([A-Za-z_]\w*)", 1)))

    used = F.flatten(F.transform(_all(text, RUST_USE), crates))
    return _prefixed(F.concat(F.filter(used, lambda c: ~c.isin("crate", "self", "super", "")), _all(text, RUST_EXTERN)), "pkg:")


def _java(text: Column) -> Column:
    return F.transform(_all(text, JAVA_IMPORT), lambda p: F.concat(F.lit("pkg:"), F.trim(p)))


def _c(text: Column) -> Column:
    return F.concat(_prefixed(_all(text, C_QUOTED), "local:"), _prefixed(_all(text, C_SYSTEM), "sys:"))


def _ruby(text: Column, relative: bool) -> Column:
    gems = _prefixed(_all(text, RUBY_REQUIRE), "pkg:")
    return F.concat(gems, _prefixed(_all(text, RUBY_RELATIVE), "local:")) if relative else gems


def import_targets(language: Column, text: Column, ruby_relative: bool = False) -> Column:
    """Array of prefixed import targets of a text in a language."""
    return (
        F.when(language == "go", _go(text))
        .when(language == "python", _python(text))
        .when(language.isin("typescript", "javascript"), _javascript(text))
        .when(language == "rust", _rust(text))
        .when(language == "java", _java(text))
        .when(language.isin("c", "cpp"), _c(text))
        .when(language == "ruby", _ruby(text, ruby_relative))
    )


def extract_imports(files: DataFrame, ruby_relative: bool = False) -> DataFrame:
    """One `imports` edge per imported name of each file."""
    known = files.select("path", "content", language_of(F.col("path")).alias("_language")).where("_language is not null")
    # Not a filter: that would be pushed to where the text is made, and make it, and the language, once per word.
    code = F.when(may_import(F.col("_language"), F.col("content")), code_only(F.col("_language"), F.col("content")))
    bare = known.withColumn("content", code)
    return bare.select(
        F.col("path").alias("from"),
        F.explode(import_targets(F.col("_language"), F.col("content"), ruby_relative)).alias("to"),
        F.lit("imports").alias("rel"),
    )


def link_edges(pages: DataFrame, path: str = "url", text: str = "html") -> DataFrame:
    """`links` edges from a page to the addresses it refers to."""
    return pages.select(
        F.col(path).alias("from"), F.explode(_all(F.col(text), 'href="([^"]*)"')).alias("to"), F.lit("links").alias("rel")
    )
