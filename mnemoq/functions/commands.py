"""Command output: a dispatch table from commands to line filters, filters as column functions, and scalars on commands."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoq.functions import automata
from mnemoq.functions.text import KINDS, MARK, brevity, combine, dedup_runs, drop_matching, lines, n_tokens, normalize, or_raw, strip_ansi, tail_lines, target_tokens, truncate_lines, unlines, window, with_extract
from mnemoq.sources import domain

# ---- line filters --------------------------------------------------------------------------------
# fixed values: what git prints while it works, at the start of a line
GIT_NOISE = r"^(remote: )?(Enumerating|Counting|Compressing|Receiving|Writing|Unpacking|Resolving|Delta compression|Total)\b"
GIT_HINTS = r"^(\(use |Your branch is up to date|no changes added to commit|$)"

Rule = Callable[[Column], Column]


def _drop(pattern: str, blank: bool = True) -> Rule:
    return lambda ls: F.filter(drop_matching(ls, pattern), lambda x: F.trim(x) != "") if blank else drop_matching(ls, pattern)


def _cap(n: int, unit: str) -> Rule:
    return lambda ls: truncate_lines(ls, n, unit)


def _then(*rules: Rule) -> Rule:
    def run(ls: Column) -> Column:
        for r in rules:
            ls = r(ls)
        return ls

    return run


def git_log(ls: Column) -> Column:
    """A commit as its short hash and first subject line; the number of commits last."""
    at = lambda i: F.get(ls, i)
    heads = F.filter(F.transform(ls, lambda x, i: F.when(F.regexp_like(x, F.lit(r"^[*|/\\ ]*commit [0-9a-f]{7,40}")), i)), lambda i: i.isNotNull())

    def one(i: Column, k: Column) -> Column:
        end = F.coalesce(F.get(heads, k + 1), F.size(ls))
        body = F.slice(ls, i + 2, F.greatest(end - i - 1, F.lit(0)))
        subject = F.get(F.filter(body, lambda x: F.regexp_like(x, F.lit(r"^[*|/\\ ]*    \S"))), F.lit(0))
        return F.concat(F.regexp_extract(at(i), r"commit ([0-9a-f]{7})", 1), F.lit(" "), F.trim(F.regexp_replace(F.coalesce(subject, F.lit("")), r"^[*|/\\ ]*", "")))

    return F.when(F.size(heads) == 0, ls).otherwise(F.concat(F.transform(heads, one), F.array(F.concat(F.size(heads).cast("string"), F.lit(" commits")))))


def git_diff(ls: Column) -> Column:
    """File and hunk headers, and for each hunk the lines added and removed with the first change."""
    heads = F.filter(F.transform(ls, lambda x, i: F.when(F.regexp_like(x, F.lit("^(diff --git |@@ )")), i)), lambda i: i.isNotNull())

    def one(i: Column, k: Column) -> Column:
        end = F.coalesce(F.get(heads, k + 1), F.size(ls))
        body = F.slice(ls, i + 2, F.greatest(end - i - 1, F.lit(0)))
        plus = F.filter(body, lambda x: F.regexp_like(x, F.lit(r"^\+(?!\+\+)")))
        minus = F.filter(body, lambda x: F.regexp_like(x, F.lit("^-(?!--)")))
        first = F.left(F.coalesce(F.get(F.filter(body, lambda x: F.regexp_like(x, F.lit(r"^[+-](?![+-]{2})"))), F.lit(0)), F.lit("")), F.lit(80))
        return F.when(F.startswith(F.get(ls, i), F.lit("@@")), F.concat(F.get(ls, i), F.lit(" +"), F.size(plus).cast("string"), F.lit(" -"), F.size(minus).cast("string"), F.lit(" :: "), first)).otherwise(F.get(ls, i))

    return F.when(F.size(heads) == 0, ls).otherwise(F.transform(heads, one))


def grouped(key: str, rest: str, most: int) -> Rule:
    """Lines `key` + `rest` by key in first-seen order; a key with one line stays in line."""
    def run(ls: Column) -> Column:
        cut = truncate_lines(ls, most, "matches")
        keys = F.transform(cut, lambda x: F.regexp_extract(x, key, 1))
        order = F.array_distinct(keys)

        def one(k: Column) -> Column:
            own = F.filter(cut, lambda x: F.regexp_extract(x, key, 1) == k)
            body = F.transform(own, lambda x: F.concat(F.lit("  "), F.regexp_extract(x, rest, 1)))
            return F.when((k == "") | (F.size(own) == 1), own).otherwise(F.concat(F.array(F.concat(k, F.lit(" ("), F.size(own).cast("string"), F.lit(")"))), body))

        return F.flatten(F.transform(order, one))

    return run


#: what is done with the lines as a whole, after the filter's state table, if it has one
SHAPES: dict[str, Rule] = {
    "git_log": git_log, "git_diff": git_diff, "git_show": git_diff, "git_status": _then(_drop(GIT_HINTS), _cap(200, "entries")),
    "git_push": _drop(GIT_NOISE), "git_pull": _drop(GIT_NOISE), "git_fetch": _drop(GIT_NOISE),
    "cargo_tree": _cap(200, "entries"), "tree": _cap(200, "entries"), "ls": _cap(200, "entries"), "pip_list": _cap(200, "packages"), "bazel_query": _cap(200, "targets"),
    "docker_ps": _cap(100, "rows"), "docker_compose": _cap(100, "rows"), "kubectl_get": _cap(100, "rows"), "gh_list": _cap(50, "rows"),
    "docker_logs": lambda x: tail_lines(x, 200), "kubectl_logs": lambda x: tail_lines(x, 200),
    "fd": grouped(r"^(.*/)[^/]+$", r"([^/]+)$", 1000), "find": grouped(r"^(.*/)[^/]+$", r"([^/]+)$", 1000),
    "read_cat": _then(dedup_runs, window), "read_head_tail": dedup_runs,
}

# fixed values: (command, first argument, second argument, filter); an empty argument matches any
DISPATCH = [
    ("git", "log", "", "git_log"),
    ("git", "diff", "", "git_diff"),
    ("git", "status", "", "git_status"),
    ("git", "show", "", "git_show"),
    ("git", "push", "", "git_push"),
    ("git", "pull", "", "git_pull"),
    ("git", "fetch", "", "git_fetch"),
    ("git", "commit", "", "git_commit"),
    ("cargo", "test", "", "cargo_test"),
    ("cargo", "build", "", "cargo_build"),
    ("cargo", "check", "", "cargo_check"),
    ("cargo", "clippy", "", "cargo_clippy"),
    ("cargo", "doc", "", "cargo_doc"),
    ("cargo", "bench", "", "cargo_bench"),
    ("cargo", "audit", "", "cargo_audit"),
    ("cargo", "tree", "", "cargo_tree"),
    ("npm", "install", "", "npm_install"),
    ("npm", "i", "", "npm_install"),
    ("npm", "ci", "", "npm_install"),
    ("npm", "test", "", "npm_test"),
    ("npm", "t", "", "npm_test"),
    ("pytest", "", "", "pytest"),
    ("pip", "install", "", "pip_install"),
    ("pip", "list", "", "pip_list"),
    ("uv", "install", "", "uv"),
    ("uv", "sync", "", "uv"),
    ("uv", "add", "", "uv"),
    ("ruff", "", "", "ruff"),
    ("mypy", "", "", "mypy"),
    ("eslint", "", "", "eslint"),
    ("tsc", "", "", "tsc"),
    ("go", "test", "", "go_test"),
    ("go", "build", "", "go_build"),
    ("go", "vet", "", "go_vet"),
    ("go", "mod", "tidy", "go_mod_tidy"),
    ("go", "mod", "download", "go_mod_download"),
    ("bazel", "build", "", "bazel_build"),
    ("bazel", "test", "", "bazel_test"),
    ("bazel", "query", "", "bazel_query"),
    ("bazel", "cquery", "", "bazel_query"),
    ("bazel", "aquery", "", "bazel_query"),
    ("bazelisk", "build", "", "bazel_build"),
    ("bazelisk", "test", "", "bazel_test"),
    ("bazelisk", "query", "", "bazel_query"),
    ("bazelisk", "cquery", "", "bazel_query"),
    ("bazelisk", "aquery", "", "bazel_query"),
    ("yarn", "install", "", "yarn_install"),
    ("yarn", "add", "", "yarn_install"),
    ("pnpm", "install", "", "pnpm_install"),
    ("pnpm", "add", "", "pnpm_install"),
    ("pnpm", "i", "", "pnpm_install"),
    ("jest", "", "", "js_test"),
    ("vitest", "", "", "js_test"),
    ("mocha", "", "", "js_test"),
    ("docker", "ps", "", "docker_ps"),
    ("docker", "images", "", "docker_ps"),
    ("docker", "logs", "", "docker_logs"),
    ("docker", "compose", "ps", "docker_compose"),
    ("docker", "compose", "logs", "docker_compose"),
    ("kubectl", "get", "", "kubectl_get"),
    ("kubectl", "logs", "", "kubectl_logs"),
    ("kubectl", "describe", "", "kubectl_describe"),
    ("gh", "pr", "list", "gh_list"),
    ("gh", "issue", "list", "gh_list"),
    ("gh", "repo", "list", "gh_list"),
    ("gh", "pr", "view", "gh_view"),
    ("gh", "issue", "view", "gh_view"),
    ("gh", "repo", "view", "gh_view"),
    ("make", "", "", "make"),
    ("mvn", "", "", "mvn"),
    ("gradle", "", "", "gradle"),
    ("./gradlew", "", "", "gradle"),
    ("rg", "", "", "rg"),
    ("grep", "", "", "rg"),
    ("tree", "", "", "tree"),
    ("fd", "", "", "fd"),
    ("find", "", "", "find"),
    ("ls", "", "", "ls"),
    ("cat", "", "", "read_cat"),
    ("bat", "", "", "read_cat"),
    ("less", "", "", "read_cat"),
    ("head", "", "", "read_head_tail"),
    ("tail", "", "", "read_head_tail"),
]


def pick(cmd: Column, args: Column) -> Column:
    """The filter's name for a command; options before a subcommand of git are passed over."""
    base = F.substring_index(cmd, "/", -1)
    plain = F.when(base == "git", F.regexp_extract_all(F.regexp_replace(F.concat_ws("\n", args), r"^(?:-[cC]\n[^\n]*\n|--[^\n]*\n)+", ""), F.lit(r"[^\n]+"), F.lit(0))).otherwise(args)
    first, second = F.coalesce(F.get(plain, F.lit(0)), F.lit("")), F.coalesce(F.get(plain, F.lit(1)), F.lit(""))
    table = F.create_map(*[F.lit(x) for c, a, b, name in DISPATCH for x in (f"{c}\n{a}\n{b}", name)])
    at = lambda c, a, b: F.element_at(table, F.concat_ws("\n", c, a, b))
    none = F.lit("")
    return F.coalesce(at(cmd, none, none), at(cmd, first, none), at(base, first, second), at(base, first, none), at(base, none, none), F.lit("generic"))


def filtered(frames: DataFrame) -> DataFrame:
    """frames (cmd, args, stdout, stderr, exit_code) with filter_id and text. Lines go through the state table of their filter, then
    through its shape; what that would empty is shown raw. Commands without a filter of their own are compressed."""
    names = frames.columns
    d = frames.withColumn("filter_id", pick(F.col("cmd"), F.col("args"))).withColumn("_raw", combine(F.col("stdout"), F.col("stderr"))).withColumn("_ls", lines(strip_ansi(F.col("_raw"))))
    d = automata.run(d)
    out = F.col("_ls")
    for name, rule in SHAPES.items():
        if name == "docker_compose":
            out = F.when((F.col("filter_id") == name) & (F.get("args", F.lit(1)) == "logs"), tail_lines(F.col("_ls"), 200)).otherwise(out)
            out = F.when((F.col("filter_id") == name) & ~F.coalesce(F.get("args", F.lit(1)) == "logs", F.lit(False)), rule(F.col("_ls"))).otherwise(out)
        else:
            out = F.when(F.col("filter_id") == name, rule(F.col("_ls"))).otherwise(out)
    other = F.col("filter_id") == "generic"
    # numbers keep steps apart that are too much for one generated method together
    shaped = unlines(F.when(F.col("_k") >= 0, F.col("_o")))
    rest = d.where(~other).select(*names, "filter_id", "_raw", "_trailer", out.alias("_o"), F.monotonically_increasing_id().alias("_k"))
    rest = rest.select(*names, "filter_id", "_raw", "_trailer", shaped.alias("_t"), F.monotonically_increasing_id().alias("_n"))
    own = F.when(F.col("_trailer").isNull() & (F.col("_n") >= 0), or_raw(F.col("_t"), F.col("_raw"))).otherwise(F.concat("_t", "_trailer", F.lit("\n")))
    rest = rest.select(*[F.col(f"`{c}`") for c in names], "filter_id", own.alias("text"))
    d = d.where(other).select(*names, "filter_id", "_raw", F.monotonically_increasing_id().alias("_n"))
    d = with_extract(d.withColumn("_g", F.when(F.col("_n") >= 0, KINDS["tool_output"](normalize(F.col("_raw"))))), target_tokens(F.col("_raw"), 0.5), "_g")
    d = d.withColumn("_m", F.monotonically_increasing_id())
    body = F.when(F.col("_m") >= 0, unlines(F.coalesce("_picks", F.array().cast("array<string>"))))
    d = d.select(*names, "filter_id", "_raw", body.alias("_b"), F.monotonically_increasing_id().alias("_k"))
    text = F.when((n_tokens(F.col("_raw")) > 0) & (F.col("_k") >= 0), F.concat(F.lit(MARK + "\n"), brevity(F.col("_b")))).otherwise(F.col("_raw"))
    return rest.unionByName(d.select(*[F.col(f"`{c}`") for c in names], "filter_id", text.alias("text")))


# ---- scalars -------------------------------------------------------------------------------------
# fixed values: words that stand before a definition's name
SYMBOL_KEYWORDS = (
    "fn", "pub", "struct", "enum", "trait", "impl", "type", "const", "static", "mod", "async", "unsafe", "class", "def", "func", "function", "interface", "export", "public", "private", "var", "let", "val",
)


def extract_symbol(pattern: Column) -> Column:
    """The symbol a search pattern is after: a bare word of three characters or more, what is called, a path's last part
    if all parts are such words, or what follows the keywords of a definition; null otherwise."""
    word = r"[A-Za-z_][A-Za-z0-9_]{2,}"
    p = F.regexp_replace(pattern, r"^\s+|\s+$", "")
    call = F.regexp_extract(p, rf"^({word})\s*\(", 1)
    after = F.regexp_extract(p, rf"^(?:(?:{'|'.join(SYMBOL_KEYWORDS)})\s++)++([A-Za-z_][A-Za-z0-9_]*)", 1)
    return (F.when(F.regexp_like(p, F.lit(rf"^{word}$")), p).when(call != "", call)
            .when(F.regexp_like(p, F.lit(rf"^{word}(?:::{word})+$")), F.substring_index(p, "::", -1))
            .when(F.length(after) >= 3, after))


def fit_left(s: Column, width: int) -> Column:
    return F.when(F.length(s) > width, F.concat(F.lit("…"), F.right(s, F.lit(width - 1)))).otherwise(s)


def csv_field(s: Column) -> Column:
    return F.when(F.regexp_like(s, F.lit('[,"\n]')), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


# ---- queries -------------------------------------------------------------------------------------
def _frames(s: SparkSession, d: str) -> DataFrame:
    """Documents as the output of every command of the dispatch table in turn."""
    table = F.array(*[F.struct(F.lit(c).alias("c"), F.array(F.lit(a), F.lit(b)).alias("a")) for c, a, b, _ in DISPATCH])
    d_ = domain.context_items(s, d).withColumn("t", F.element_at(table, (F.col("id").cast("int") % len(DISPATCH)) + 1))
    return d_.select("id", F.col("t.c").alias("cmd"), F.filter(F.col("t.a"), lambda x: x != "").alias("args"), F.col("content").alias("stdout"), F.lit("").alias("stderr"), F.lit(0).alias("exit_code"))


def _patterns(s: SparkSession, d: str) -> DataFrame:
    shapes = F.array(*[F.lit(x) for x in ('{n}', '{n}(', 'fn {n}', 'pub async fn {n}(x: T)', 'abc::{n}', 'x.{n}', '{n} {n}', 'pub fn', 'ab', '  {n}  ', '{n} (a, b)', 'pub fn (', 'a::{n}', 'def {n}:')])
    return domain.read(s, d, "part").select("p_partkey", F.replace(F.element_at(shapes, (F.col("p_partkey") % 14).cast("int") + 1), F.lit("{n}"), F.regexp_replace("p_name", " ", "_")).alias("p"))


#: planted outputs: (command, arguments, output, exit code) and the text that its filter must give; {n} is the row's number
PLANTED: dict[str, tuple[str, str, str, int, str]] = {
    "h16_cargo_build": ("cargo", "build", "   Compiling p{n} v0.1\nwarning: unused `v{n}`\n  --> src/a.rs:{n}:1\n   |\n 3 | let x;\n   = note: n\n\nwarning: 1 warning emitted\nerror[E0{n}]: bad\n  --> b.rs:2:1\n   |\n\n    Finished dev\n", 101,
                        "warning: unused `v{n}`\n  --> src/a.rs:{n}:1\nwarning: 1 warning emitted\nerror[E0{n}]: bad\n  --> b.rs:2:1\n   |\n\n[2 warnings, 1 errors, exit 101]\n"),
    "h16_cargo_check": ("cargo", "check", "    Checking a{n}\nwarning: w\n  --> x.rs:1:1\n  --> y.rs:1:1\nplain\n\nafter {n}\n", 0, "warning: w\n  --> x.rs:1:1\nafter {n}\n[1 warnings, 0 errors, exit 0]\n"),
    "h17_cargo_clippy": ("cargo", "clippy", "warning: this {n}\n  --> a.rs:1:1\n  | body\n\n\nwarning: that\n", 0, "warning: this {n}\n  --> a.rs:1:1\n  | body\n\nwarning: that\n[2 warnings, 0 errors, exit 0]\n"),
    "h18_cargo_test": ("cargo", "test", "running 4 tests\ntest a::b{n} ... ok\ntest a::c ... ignored\ntest a::d ... FAILED\n\n---- a::d stdout ----\nthread 'd' panicked at {n}\nstack backtrace:\n   0: x\n   1: y\n\nnote: run with `RUST_BACKTRACE=1`\nPASS [   0.005s] p q{n}\nFAIL [   0.100s] p r\ntest result: FAILED\n", 101,
                       "running 4 tests\ntest a::d ... FAILED\n\n---- a::d stdout ----\nthread 'd' panicked at {n}\n\nFAIL [   0.100s] p r\ntest result: FAILED\n[tests 4 (passed 2, failed 2, ignored 1), exit 101]\n"),
    "h19_cargo_bench": ("cargo", "bench", "     Running benches/b{n}\ntest b{n} ... bench: 5 ns/iter\ntest c ... bench: 6 ns/iter\n", 0, "test b{n} ... bench: 5 ns/iter\ntest c ... bench: 6 ns/iter\n[2 results, exit 0]\n"),
    "h20_cargo_audit": ("cargo", "audit", "    Fetching advisory database from x\n    Scanning Cargo.lock\nID: R-{n}\n", 1, "ID: R-{n}\n[exit 1]\n"),
    "h15_git_commit": ("git", "commit", "[main a{n}] m\n 2 files changed\n create mode 100644 x\n rename a => b{n}\n", 0, "[main a{n}] m\n 2 files changed\n[2 file-mode lines hidden]\n"),
    "h22_npm_install": ("npm", "i", "added 3 packages\nadded 5 packages in 2s\n\nup to date, audited {n} packages\n", 0, "added 5 packages in 2s\nup to date, audited {n} packages\n[exit 0]\n"),
    "h23_npm_test": ("npm", "t", "  ✓ works {n}\nPASS a.js\n  ✕ fails {n}\n", 1, "  ✕ fails {n}\n[exit 1]\n"),
    "h24_pytest": ("pytest", "", "....x [ 50%]\nt.py::a{n} PASSED\nt.py::b FAILED\nE assert {n}\n", 1, "t.py::b FAILED\nE assert {n}\n[dropped 2 progress and passed lines, exit 1]\n"),
    "h25_pip_install": ("pip", "install", "Collecting a{n}\n  Downloading a.whl\nSuccessfully installed a-{n}\n", 0, "Successfully installed a-{n}\n[dropped 2 progress lines, exit 0]\n"),
    "h27_uv": ("uv", "sync", "Resolved 12 packages in 1ms\n + a==1\nwarning: {n}\n", 0, "warning: {n}\n[dropped 2 progress lines, exit 0]\n"),
    "h28_ruff": ("ruff", "check", "All checks passed!\na.py:{n}: E1\n", 1, "a.py:{n}: E1\n[exit 1]\n"),
    "h28_mypy": ("mypy", "", "Success: no issues found\na.py:{n}: error: x\nb.py:1: note: y\n", 1, "a.py:{n}: error: x\nb.py:1: note: y\n[1 errors, exit 1]\n"),
    "h28_eslint": ("eslint", "src", "a.js\n  {n}:1  error  bad\n  2:1  warning  so, an error too\n", 1, "a.js\n  {n}:1  error  bad\n  2:1  warning  so, an error too\n[2 errors, 1 warnings, exit 1]\n"),
    "h28_tsc": ("tsc", "", "Starting compilation in watch mode\na.ts({n},1): error TS2304: x\n", 2, "a.ts({n},1): error TS2304: x\n[1 errors, exit 2]\n"),
    "h29_go_test": ("go", "test", "=== RUN   TestA{n}\n--- PASS: TestA (0.00s)\n--- FAIL: TestB{n} (0.00s)\npanic: x\ngoroutine 7 [running]:\nmain.f()\n\t/a.go:1\n\nexit\ngoroutine 8 [chan]:\ng()\nFAIL\tp/a{n}\t0.1s\nok  \tp/b\t0.2s\nok\tp/c\t0.2s\nPASS\n", 1,
                    "--- FAIL: TestB{n} (0.00s)\npanic: x\nexit\nFAIL\tp/a{n}\t0.1s\nok  \tp/b\t0.2s\nok\tp/c\t0.2s\n[2 packages ok, 1 failed, exit 1]\n"),
    "h30_go_build": ("go", "build", "# p{n}\na.go:1:2: undefined: x\nb.go:2:1: some error\nnote\n", 1, "# p{n}\na.go:1:2: undefined: x\nb.go:2:1: some error\nnote\n[2 errors, exit 1]\n"),
    "h31_go_mod": ("go", "mod tidy", "go: downloading a v{n}\ngo: finding b\ngo: warning {n}\n", 0, "go: warning {n}\n[dropped 2 progress lines, exit 0]\n"),
    "h32_bazel_build": ("bazelisk", "build", "Loading: 0\n[1,024 / 2,048] Compiling\nERROR: //a:{n} failed\nINFO: Build completed\n", 1, "ERROR: //a:{n} failed\nINFO: Build completed\n[1 errors, exit 1]\n"),
    "h33_bazel_test": ("bazel", "test", "//a:x{n} PASSED in 1s\n//a:y FAILED in {n}s\n//a:z (cached) PASSED\n//a:f FLAKY\nsummary\n", 3, "//a:y FAILED in {n}s\n//a:f FLAKY\nsummary\n[2 passed, 2 failed targets, exit 3]\n"),
    "h34_bazel_query": ("bazel", "aquery", "Loading: 1\n//a:{n}\n//b:c\n", 0, "//a:{n}\n//b:c\n"),
    "h35_yarn": ("yarn", "add", "[1/4] Resolving packages\n[2/4] Fetching packages\nsuccess {n}\n", 0, "success {n}\n[dropped 2 progress lines, exit 0]\n"),
    "h35_pnpm": ("pnpm", "i", "Progress: resolved 1\n...\ndependencies: {n}\n", 0, "dependencies: {n}\n[dropped 2 progress lines, exit 0]\n"),
    "h36_js_test": ("mocha", "", "  ✓ a {n}\nPASS b\nok 1\nnot ok {n}\n", 1, "not ok {n}\n[dropped 3 pass lines, exit 1]\n"),
    "h41_kubectl_describe": ("kubectl", "describe", "Name:   p{n}\nLabels: a=b\n        c=d\nAnnotations: x\nStatus: Running\nSpec:\n  y: z\nConditions:\n  Ready True {n}\nSelector: q\n  w\nOther:\n  kept\nQoS Class: Best\nEvents: none\n", 0,
                             "Name:   p{n}\nStatus: Running\nConditions:\n  Ready True {n}\nOther:\n  kept\nEvents: none\n[describe trimmed, exit 0]\n"),
    "h43_gh_view": ("gh", "pr view", "title {n}\n--\nann (2 days ago)\nc2\n--\nc3 {n}\n--\nc4\nbob (3 days ago)\nc5\n", 0, "title {n}\n--\nann (2 days ago)\nc2\n--\nc3 {n}\n[hid 2 comments]\n"),
    "h44_make": ("make", "all", "make[1]: Entering directory '/a'\ngcc -c x{n}.c\nx.c:1: error {n}\n", 2, "x.c:1: error {n}\n[dropped 2 echo and folder lines, exit 2]\n"),
    "h45_mvn": ("mvn", "package", "[INFO] Downloading from central: a\n[INFO] BUILD {n}\n", 0, "[INFO] BUILD {n}\n[dropped 1 download lines, exit 0]\n"),
    "h45_gradle": ("./gradlew", "build", "> Task :compile{n}\nBUILD SUCCESSFUL {n}\n", 0, "BUILD SUCCESSFUL {n}\n[dropped 1 progress lines, exit 0]\n"),
    "h46_rg": ("rg", "x src", "src/a{n}.rs:1:x\nb.rs:2:y\nsrc/a{n}.rs:3:z\nno match line\nurl\n", 0, "src/a{n}.rs:\n  1:x\n  3:z\nb.rs:2:y\nno match line\nurl\n"),
    "h46_rg_context": ("grep", "-rnA2 x", "a.rs:{n}:x\na.rs-2-y\na.rs:3:z\n", 0, "a.rs:{n}:x\na.rs-2-y\na.rs:3:z\n"),
    "h47_tree": ("tree", "", ".\n├── a{n}\n│   ├── b\n│   │   └── c\n│   │   │   └── d\n", 0, ".\n├── a{n}\n│   ├── b\n│   │   └── c\n[hid 1 entries below depth 3]\n"),
    "h50_read_cat": ("cat", "-n src/a.py", "# head {n}\nx = {n}\n\n\n\n  # in\ny\ny\ny\n", 0, "x = {n}\n\ny\n  + 2 more identical lines\n"),
    "h51_read_head": ("head", "-n 20 a.go", "// c\nfunc f{n}() {\n  // d\n}\n", 0, "func f{n}() {\n}\n"),
    "h51_read_text": ("tail", "-n 5 notes.txt", "# kept {n}\n\n\n", 0, "# kept {n}\n\n  + 1 more identical lines\n"),
    "h39_compose_logs": ("docker", "compose logs", "".join(f"l{i} {{n}}\n" for i in range(203)), 0, "… 3 earlier lines\n" + "".join(f"l{i} {{n}}\n" for i in range(3, 203))),
    "h39_compose_ps": ("docker", "compose ps", "".join(f"r{i} {{n}}\n" for i in range(103)), 0, "".join(f"r{i} {{n}}\n" for i in range(100)) + "… 3 more rows\n"),
    "h12_git_status": ("git", "status", "On branch b{n}\nYour branch is up to date with x\n  (use \"git add\")\n\n\tmodified: f{n}\n", 0, "On branch b{n}\n\tmodified: f{n}\n"),
    "h14_git_push": ("git", "push", "Enumerating objects: {n}\nremote: Resolving deltas: 1\nTo x\n a..b main\n", 0, "To x\n a..b main\n"),
    "h10_git_log": ("git", "log", "commit abcdef0{n}aaaa\nAuthor: a\n\n    Subject {n}\n\n    body\ncommit 1234567890ab\n\n    Second\n", 0, "abcdef0 Subject {n}\n1234567 Second\n2 commits\n"),
    "h11_git_diff": ("git", "diff", "diff --git a/x{n} b/x\n--- a/x\n+++ b/x\n@@ -1,2 +1,3 @@\n-old {n}\n+new\n+more\n ctx\n", 1, "diff --git a/x{n} b/x\n@@ -1,2 +1,3 @@ +2 -1 :: -old {n}\n"),
}


def _planted(name: str):
    cmd, args, out, code, _ = PLANTED[name]

    def run(s: SparkSession, d: str) -> DataFrame:
        p = domain.read(s, d, "part").select("p_partkey", F.lit(cmd).alias("cmd"), F.array(*[F.lit(a) for a in args.split()]).cast("array<string>").alias("args"),
                                             F.replace(F.lit(out), F.lit("{n}"), F.col("p_partkey").cast("string")).alias("stdout"), F.lit("").alias("stderr"), F.lit(code).alias("exit_code"))
        return filtered(p).select("p_partkey", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))

    return run


def _expected(name: str) -> str:
    text = PLANTED[name][4].replace("'", "''").replace("\n", "' || chr(10) || '")
    return f"SELECT p_partkey, sha256(replace('{text}', '{{n}}', p_partkey::VARCHAR)) AS sha FROM part"


QUERIES = {
    "h10_filters": lambda s, d: filtered(_frames(s, d)).select("id", "filter_id", F.length("text").alias("chars")),
    "h9_group_prefix": lambda s, d: domain.context_items(s, d).select("id", F.size(grouped(r"^(\S+) ", r"^\S+ (.*)$", 100)(lines(F.col("content")))).alias("n")),
    "i6_extract_symbol": lambda s, d: _patterns(s, d).select("p_partkey", extract_symbol(F.col("p")).alias("symbol")),
    "i11_fit_left": lambda s, d: domain.entities(s, d).select("id", fit_left(F.col("signature"), 12).alias("fitted")),
    "i12_csv": lambda s, d: domain.bugs(s, d).select("id", csv_field(F.col("summary")).alias("field")),
}

ORACLES = {
    "i6_extract_symbol": "SELECT p_partkey, CASE WHEN p_partkey % 14 IN (0, 1, 2, 3, 4, 9, 10, 13) THEN replace(p_name, ' ', '_') WHEN p_partkey % 14 = 7 THEN NULL END AS symbol FROM part",
    "i11_fit_left": domain.duck("entities") + " SELECT id, CASE WHEN length(signature) > 12 THEN '…' || right(signature, 11) ELSE signature END AS fitted FROM entities",
    "i12_csv": domain.duck("bugs") + " SELECT id, CASE WHEN regexp_matches(summary, '[,\"\\n]') THEN '\"' || replace(summary, '\"', '\"\"') || '\"' ELSE summary END AS field FROM bugs",
}

for _name in PLANTED:
    QUERIES[_name], ORACLES[_name] = _planted(_name), _expected(_name)
