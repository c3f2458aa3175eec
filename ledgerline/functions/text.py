"""Scalar functions over paths, commit messages, months and emails, all as
column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: UNIX lines and Unicode classes: the dialect the patterns are written for.
U = "(?dU)"

# --- fixed values -----------------------------------------------------------
EXTENSIONS = {
    "py": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "ts": "typescript", "tsx": "typescript", "java": "java", "go": "go", "rb": "ruby", "php": "php", "cs": "csharp",
    "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "rs": "rust",
    "kt": "kotlin", "kts": "kotlin", "swift": "swift", "scala": "scala", "sc": "scala", "dart": "dart", "sql": "sql",
    "sh": "shell", "bash": "shell", "zsh": "shell", "html": "html", "htm": "html", "css": "css", "scss": "css", "sass": "css",
    "yaml": "yaml", "yml": "yaml", "r": "r", "m": "objc", "mm": "objc", "lua": "lua", "pl": "perl", "pm": "perl",
    "ex": "elixir", "exs": "elixir", "erl": "erlang", "hs": "haskell", "ml": "ocaml", "mli": "ocaml", "clj": "clojure",
    "nix": "nix", "tcl": "tcl", "vhd": "vhdl", "vhdl": "vhdl", "v": "verilog", "sv": "verilog", "adb": "ada", "ads": "ada",
    "f": "fortran", "f90": "fortran", "f95": "fortran", "for": "fortran", "cob": "cobol", "cbl": "cobol", "asm": "assembly", "s": "assembly",
}
SUITABILITY = {
    "python": 1.00, "javascript": 1.00, "typescript": 1.00, "java": 0.90, "go": 0.90, "csharp": 0.90, "php": 0.85, "ruby": 0.85,
    "cpp": 0.80, "c": 0.75, "rust": 0.80, "kotlin": 0.80, "swift": 0.78, "scala": 0.70, "dart": 0.70, "sql": 0.65, "shell": 0.60,
    "html": 0.60, "css": 0.55, "r": 0.60, "yaml": 0.45, "lua": 0.50, "objc": 0.55, "perl": 0.45, "elixir": 0.50, "haskell": 0.45,
    "clojure": 0.45, "ocaml": 0.40, "erlang": 0.35, "nix": 0.30, "tcl": 0.25, "assembly": 0.25, "vhdl": 0.15, "verilog": 0.15,
    "ada": 0.15, "fortran": 0.20, "cobol": 0.10,
}
OTHER, OTHER_SUITABILITY = "other", 0.40
NOT_SOURCE = ("other", "yaml", "html", "css")
VENDOR_DIRS = ("vendor", "third_party", "third-party", "node_modules", "bower_components", ".venv", "venv", "dist", "build", "out", "target", ".git", "Pods", "Carthage", "external", "deps", "godeps", "site-packages")
LOCK_FILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "composer.lock", "Cargo.lock", "poetry.lock", "Pipfile.lock", "Gemfile.lock", "go.sum", "flake.lock", "packages.lock.json", "gradle.lockfile")
GENERATED_SUFFIXES = (".min.js", ".min.css", ".map", ".pb.go", "_pb2.py", "_pb2_grpc.py", ".pb.cc", ".pb.h", ".g.dart", ".freezed.dart", ".designer.cs", ".generated.go")
GENERATED = r"(?i)(^|/)(dist|build|generated|__generated__|migrations|snapshots|__snapshots__|fixtures|testdata|vendored|gen)(/|$)"
BULLET = r"(?m)^\s*(?:[-*+]|\d+[.)])\s+\S"
WORD = r"([A-Za-z][A-Za-z0-9_']*)"
BUGFIX = r"(?i)^(?:fix|bugfix|hotfix|patch)(?:\(|:|!)|(?<!\w)\bfix(?:e[sd])?\b"
FEATURE = r"(?i)^(?:feat|feature)(?:\(|:|!)|\b(?:add|implement|introduce)\b"
PRECISE_TERMS = {"claude": r"\bclaude\b", "copilot": r"\bcopilot\b", "chatgpt": r"\bchatgpt\b", "gpt": r"\bgpt-?[34o]\b", "tabnine": r"\btabnine\b", "codeium": r"\bcodeium\b", "ai_generic": r"\bai[- ]generated\b|\bwith ai\b|\busing ai\b"}
AMBIGUOUS_TERMS = {"cursor": r"\bcursor\b", "cody": r"\bcody\b", "windsurf": r"\bwindsurf\b", "aider": r"\baider\b"}
CONTEXT = r"(?i)\b(?:ai|llm|assistant|autocomplete|ide|chatbot|prompt|generat(?:e[ds]?|ing|ion))\b"
COAUTHOR, MADE = r"co-authored-by:[^\n]*", r"(?:generated (?:with|by)|assisted by)[^\n]*"
SIGNATURES = {
    "claude": [r"noreply@anthropic\.com", rf"(?i){COAUTHOR}claude", rf"(?i){MADE}claude(?: code)?", r"(?i)claude code"],
    "copilot": [r"(?i)copilot(?:@|\[bot\]| ide)", rf"(?i){COAUTHOR}copilot", rf"(?i){MADE}(?:github )?copilot"],
    "cursor": [rf"(?i){COAUTHOR}cursor", rf"(?i){MADE}cursor", r"(?i)cursor\.(?:so|com)|cursoragent"],
    "aider": [rf"(?i){COAUTHOR}aider", r"(?i)(?:^|\n)aider:", r"(?i)aider\.chat"],
    "codeium": [r"(?i)codeium|windsurf"],
    "cody": [r"(?i)sourcegraph cody|(?:^|\W)cody ai"],
    "devin": [rf"(?i){MADE}devin|devin-ai|cognition labs"],
    "tabnine": [r"(?i)tabnine"],
}
BOT_AUTHORS = {"copilot": "copilot", "cursoragent": "cursor", "devin-ai-integration[bot]": "devin", "aider": "aider"}
#: One of these is in every text that a term's or a signature's pattern finds.
MENTION_NEEDLES = ("claude", "copilot", "gpt", "tabnine", "codeium", "ai[- ]generated", "with ai", "using ai", "cursor", "cody", "windsurf", "aider")
SIGNATURE_NEEDLES = ("anthropic", "claude", "copilot", "cursor", "aider", "codeium", "windsurf", "cody", "devin", "cognition labs", "tabnine")
BLOCKED_WORDS = ("proxy", "proxies", "iptv", "v2ray", "vpn", "clash", "v2raycfg", "shadowsocks", "m3u", "playlist", "subscribe", "-sub", "wordlist", "ip-list", "iplist", "free-proxy", "freeproxy", "getproxy", "socks5")
LINGUIST = ("c++", "c#", "objective-c", "objective-c++", "jupyter notebook")
# ----------------------------------------------------------------------------


def _literal_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def resolve_path(path: Column) -> Column:
    """Path after a rename in numstat notation."""
    inner = F.regexp_replace(path, r"\{[^{}]* => ([^{}]*)\}", "$1")
    whole = F.when(F.instr(inner, " => ") > 0, F.substring_index(inner, " => ", -1)).otherwise(inner)
    return F.regexp_replace(F.replace(whole, F.lit("//"), F.lit("/")), U + r"^\s+|\s+$", "")


def classify_language(path: Column) -> Column:
    base = F.element_at(F.split(path, "/"), -1)
    ext = F.when(F.instr(base, ".") > 0, F.lower(F.substring_index(base, ".", -1)))
    return F.coalesce(F.try_element_at(_literal_map(EXTENSIONS), ext), F.lit(OTHER))


def suitability(lang: Column, scores: dict | None = None) -> Column:
    return F.coalesce(F.try_element_at(_literal_map(scores or SUITABILITY), lang), F.lit(OTHER_SUITABILITY))


def is_source(lang: Column) -> Column:
    return ~lang.isin(*NOT_SOURCE)


def is_excluded(path: Column) -> Column:
    """Vendored, locked or generated; an empty or null path too."""
    parts = F.split(path, "/")
    base = F.element_at(parts, -1)
    suffix = F.lit(False)
    for s in GENERATED_SUFFIXES:
        suffix = suffix | F.endswith(base, F.lit(s))
    return F.coalesce((path == "") | F.arrays_overlap(parts, F.array(*map(F.lit, VENDOR_DIRS))) | base.isin(*LOCK_FILES) | suffix | path.rlike(U + GENERATED), F.lit(True))


def numstat_int(x: Column) -> Column:
    return F.when(x == "-", F.lit(0)).otherwise(F.try_to_number(x, F.lit("999999999999999999"))).cast("bigint")


def hash_email(email: Column, salt: str) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(salt), F.char(F.lit(0)), F.lower(email)), 256), 1, 16)


def words_of(body: Column) -> Column:
    return F.regexp_extract_all(body, F.lit(WORD), F.lit(1))


def message_features(body: Column, words: Column | None = None) -> dict[str, Column]:
    """words: a column that holds words_of(body), if there is one."""
    words = words_of(body) if words is None else words
    n = F.size(words)
    return {
        "chars": F.length(body).cast("double"),
        "words": n.cast("double"),
        "lines": (F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit(""))) + 1).cast("double"),
        "has_bullets": body.rlike(U + BULLET).cast("double"),
        "unique_word_ratio": F.when(n > 0, F.size(F.array_distinct(F.transform(words, F.lower))) / n).otherwise(0.0),
    }


def classify_commit(body: Column, bugfix: str = BUGFIX, feature: str = FEATURE) -> Column:
    subject = F.substring_index(body, "\n", 1)
    return F.when(subject.rlike(U + bugfix), "bugfix").when(subject.rlike(U + feature), "feature")


def holds_any(text: Column, needles: tuple[str, ...]) -> Column:
    """One pass over a text for all needles; a text without one meets no other pattern."""
    return text.rlike(U + f"(?i){'|'.join(needles)}")


def mention_flags(body: Column, precise: dict | None = None, ambiguous: dict | None = None, context: str = CONTEXT) -> dict[str, Column]:
    """A boolean column for each term; ambiguous ones need a context word."""
    gate = holds_any(body, MENTION_NEEDLES) if precise is None and ambiguous is None else F.lit(True)
    out = {t: gate & body.rlike(U + "(?i)" + p) for t, p in (PRECISE_TERMS if precise is None else precise).items()}
    # The term first: fewer texts hold it than a context word.
    return out | {t: gate & body.rlike(U + "(?i)" + p) & body.rlike(U + context) for t, p in (AMBIGUOUS_TERMS if ambiguous is None else ambiguous).items()}


def mention_set(body: Column) -> Column:
    """The terms a message mentions, in order: bare ones, with ambiguous ones near a context word."""
    flags = mention_flags(body)
    some = lambda terms: F.filter(F.array(*(F.when(flags[t], F.lit(t)) for t in terms)), lambda x: x.isNotNull())
    return F.array_sort(F.array_union(some(PRECISE_TERMS), some(AMBIGUOUS_TERMS)))


def code_languages() -> list[str]:
    """Names of languages that mark a source repository."""
    return sorted({*EXTENSIONS.values(), *LINGUIST})


def signature_flags(name: Column, email: Column, body: Column) -> dict[str, Column]:
    text, who = F.concat_ws("\n", name, body), F.concat_ws(" ", F.lower(email), F.lower(name))
    gate, out = holds_any(text, SIGNATURE_NEEDLES), {}
    for cls, patterns in SIGNATURES.items():
        hit = F.lit(False)
        for p in patterns:
            hit = hit | text.rlike(U + p)
        hit = gate & hit
        for needle, bot in BOT_AUTHORS.items():
            if bot == cls:
                hit = hit | (F.instr(who, needle) > 0)
        out[cls] = hit
    return out


def is_code_repo(language: Column, name: Column, description: Column) -> Column:
    hay = F.lower(F.concat_ws(" ", name, description))
    blocked = F.lit(False)
    for w in BLOCKED_WORDS:
        blocked = blocked | (F.instr(hay, w) > 0)
    return F.lower(language).isin(*code_languages()) & ~blocked


def clean_ym(x: Column) -> Column:
    y = F.regexp_replace(x, r"^\n+", "")
    return F.when(y.rlike(r"^\d{4}-\d{2}$"), y).when(F.substring(y, 1, 4).rlike(r"^\d{4}$"), F.substring(y, 1, 4)).otherwise(y)


def ym_ord(ym: Column) -> Column:
    return F.substring(ym, 1, 4).cast("int") * 12 + F.substring(ym, 6, 2).cast("int") - 1


def ord_ym(o: Column) -> Column:
    return F.concat_ws("-", F.lpad(F.floor(o / 12).cast("string"), 4, "0"), F.lpad((o % 12 + 1).cast("string"), 2, "0"))


def anchor_ord(anchor: str) -> int:
    return int(anchor[:4]) * 12 + int(anchor[5:7]) - 1


def clip(x: Column, at: float) -> Column:
    return F.least(F.greatest(x, F.lit(-at)), F.lit(at))


def pct_change(pre: Column, post: Column) -> Column:
    """Unrounded; null if pre is zero."""
    return F.when(pre != 0, 100 * (post - pre) / F.abs(pre))


def as_bool(x: Column) -> Column:
    return F.lower(x.cast("string")).isin("true", "1", "yes")


def preliminary_p_ai(classes: Column, share: Column) -> Column:
    return F.when(classes > 0, F.least(F.lit(0.99), 0.90 + 0.03 * F.least(classes, F.lit(3)) + 0.05 * share))
