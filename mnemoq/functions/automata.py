"""Output filters as state tables: each is a list of steps, and one fold runs a command's lines through the table of its filter.

A step has the states it is for ("" is the first one; None is any), a pattern, what becomes of the line (keep, drop, or
go on to the next steps), the state that follows (None: as it was) and the names it counts. The first step that fits and
doesn't go on decides; a line that none decides is kept. Counts fill the trailer, a last line.

Frames of all filters run in one pass: a task looks up the table by the frame's filter, so that no expression has a
branch for each of them. Lines are worked on one by one within a frame; a frame is a row and is never cut.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

KEEP, DROP, ON = "keep", "drop", "on"
BLANK, ANY = r"^\s*$", r""


class Step(NamedTuple):
    when: tuple[str, ...] | None
    match: str
    do: str
    then: str | None = None
    count: tuple[str, ...] = ()


class Table(NamedTuple):
    steps: list[Step]
    trailer: str | None = None
    #: the trailer is left out where this count is 0
    if_any: str | None = None


def dropping(pattern: str, what: str) -> Table:
    return Table([Step(None, rf"^\s*(?:{pattern})", DROP, count=("dropped",))], f"[dropped {{dropped}} {what}, exit {{exit}}]")


# fixed values: what each tool prints while it works, where its sections begin and end, and what is counted
CARGO_PROGRESS = r"^\s*(Compiling|Checking|Downloading|Downloaded|Updating|Fresh|Finished|Building|Running|Documenting)\b"
AUDIT_PROGRESS = r"^\s*(Fetching advisory database|Loaded|Updating crates\.io index|Scanning)"
BAZEL_PROGRESS = r"^\s*(\[[\d,]+ / [\d,]+\]|Loading:|Analyzing:|INFO: Analyzed |INFO: Found |Starting local Bazel server|Computing main repo mapping|INFO: \d+)"
DESCRIBE_KEPT = r"^(Name|Namespace|Status|Conditions|Events|Containers|Image|Ports|Restart Count|Ready):"
DESCRIBE_DROPPED = r"^(Spec|Annotations|Labels|Selector|Volumes|Node-Selectors|Tolerations|QoS Class):"
SEARCH_AS_IT_IS = ("--json", "-l", "--files-with-matches", "-L", "--files-without-match", "--heading", "--context", "--after-context", "--before-context")
COMMENTS = {"py": "#", "rs": "//", "go": "//", "js": "//", "ts": "//", "jsx": "//", "tsx": "//"}
MOST_MATCHES, MOST_CHARS = 200, 1000


def _cargo(warnings: str) -> Table:
    """Diagnostics whole, but for warnings that shrink to their header and first place."""
    return Table([
        Step(("body",), BLANK, KEEP, ""), Step(None, BLANK, DROP, ""), Step(None, CARGO_PROGRESS, DROP),
        Step(None, r"^\s*warning:", KEEP, warnings, ("warnings",)), Step(None, r"^\s*error", KEEP, "body", ("errors",)),
        Step(("short",), r"^\s*-->", KEEP, "placed"), Step(("short", "placed"), ANY, DROP),
    ], "[{warnings} warnings, {errors} errors, exit {exit}]")


def _lint(progress: str | None, errors: str | None = None, warnings: str | None = None) -> Table:
    counts = [Step(None, p, ON, count=(n,)) for p, n in ((errors, "errors"), (warnings, "warnings")) if p]
    return Table([*([Step(None, progress, DROP)] if progress else []), *counts], "[" + "".join(f"{{{s.count[0]}}} {s.count[0]}, " for s in counts) + "exit {exit}]")


def _read(mark: str | None) -> Table:
    """Without comment lines, and of blank lines in a row only the first; other files as they are."""
    return Table([Step(None, rf"^\s*{mark}", DROP), Step(("blank",), BLANK, DROP), Step(None, BLANK, KEEP, "blank"), Step(None, ANY, KEEP, "")] if mark else [])


_tree = Table([Step(None, r"^(?:[│ ]   ){3,}", DROP, count=("hidden",))], "[hid {hidden} entries below depth 3]", "hidden")
_build = Table([Step(None, r"^(?=.*: )(?=.*(?:error|undefined:))", KEEP, count=("errors",))], "[{errors} errors, exit {exit}]")
TABLES: dict[str, Table] = {
    "cargo_build": _cargo("short"), "cargo_check": _cargo("short"), "cargo_doc": _cargo("short"), "cargo_clippy": _cargo("body"),
    "cargo_test": Table([
        Step(("trace",), r"^\s*($|----|test result:|failures:)", ON, ""), Step(("trace",), ANY, DROP), Step(None, r"^\s*stack backtrace:$", DROP, "trace"),
        Step(None, r"^\s*note: (run with `RUST_BACKTRACE|Some details are omitted)", DROP), Step(None, CARGO_PROGRESS, DROP),
        Step(None, r"^\s*test \S+ \.\.\. ok\b", DROP, count=("total", "passed")), Step(None, r"^\s*test \S+ \.\.\. ignored\b", DROP, count=("total", "ignored")),
        Step(None, r"^\s*PASS \[\s*\d+\.\d+s\]", DROP, count=("total", "passed")), Step(None, r"^\s*---- .*stdout ----$", ON, count=("failed",)),
        Step(None, r"^\s*FAIL \[\s*\d+\.\d+s\]", KEEP, count=("total", "failed")),
    ], "[tests {total} (passed {passed}, failed {failed}, ignored {ignored}), exit {exit}]"),
    "cargo_bench": Table([Step(None, CARGO_PROGRESS, DROP), Step(None, r"^\s*test .*bench:", KEEP, count=("results",))], "[{results} results, exit {exit}]"),
    "cargo_audit": Table([Step(None, AUDIT_PROGRESS, DROP)], "[exit {exit}]"),
    "npm_install": Table([Step(None, r"^\s*added (?!.*(?:found|audited))(?=.*package)(?!.* in )", DROP), Step(None, BLANK, DROP)], "[exit {exit}]"),
    "npm_test": Table([Step(None, r"^\s*(✓|PASS)", DROP)], "[exit {exit}]"),
    "js_test": dropping(r"✓|PASS |ok ", "pass lines"),
    "yarn_install": dropping(r"\[\d+/\d+\] (Resolving|Fetching|Linking|Building)", "progress lines"),
    "pnpm_install": dropping(r"Progress: |Packages: |\.+\s*$|Resolving: |Fetching: ", "progress lines"),
    "pytest": dropping(r"[.sxF]+\s*\[\s*\d+%\]\s*$|.*::\S+ PASSED\b", "progress and passed lines"),
    "pip_install": dropping(r"(Collecting|Downloading|Using cached|Installing collected|Requirement already satisfied|Obtaining)\b", "progress lines"),
    "uv": dropping(r"Resolved \d+ packages|Downloaded \d+|Built \d+|Prepared \d+|\+ |Updating https?://", "progress lines"),
    "ruff": _lint(r"^\s*(All checks passed!|Found \d+ errors? \(\d+ fixed\))"), "mypy": _lint(r"^\s*Success: no issues found", ": error:"),
    "eslint": _lint(None, " error", " warning"), "tsc": _lint(r"^\s*(File change detected\.|Watching for file changes\.|Starting compilation)", " error TS"),
    "go_test": Table([
        Step(("dump",), BLANK, DROP, ""), Step(("dump",), r"^\s*(FAIL\t|ok\t|ok  \t|--- |=== |exit status)", ON, ""), Step(("dump",), ANY, DROP),
        Step(None, r"^\s*goroutine \d+ \[", DROP, "dump"), Step(None, r"^\s*(=== (RUN|PAUSE|CONT)|--- PASS:|PASS$)", DROP),
        Step(None, r"^ok(  )?\t", KEEP, count=("ok",)), Step(None, r"^FAIL\t", KEEP, count=("failed",)),
    ], "[{ok} packages ok, {failed} failed, exit {exit}]"),
    "go_build": _build, "go_vet": _build,
    "go_mod_tidy": dropping(r"go: (downloading|finding|extracting|upgraded) ", "progress lines"), "go_mod_download": dropping(r"go: (downloading|finding|extracting|upgraded) ", "progress lines"),
    "bazel_build": Table([Step(None, BAZEL_PROGRESS, DROP), Step(None, r"^\s*ERROR:", KEEP, count=("errors",))], "[{errors} errors, exit {exit}]"),
    "bazel_test": Table([
        Step(None, BAZEL_PROGRESS, DROP), Step(None, r"^\s*(?=.*PASSED)(//|.*\(cached\))", DROP, count=("passed",)), Step(None, r"^\s*//.*(FAILED|FLAKY|TIMEOUT)", KEEP, count=("failed",)),
    ], "[{passed} passed, {failed} failed targets, exit {exit}]"),
    "bazel_query": Table([Step(None, BAZEL_PROGRESS, DROP)]),
    "kubectl_describe": Table([
        Step(None, DESCRIBE_DROPPED, DROP, "off"), Step(None, DESCRIBE_KEPT, KEEP, ""), Step(None, r"^[^ \s]\S*:(\s|$)", KEEP, ""), Step(("off",), ANY, DROP),
    ], "[describe trimmed, exit {exit}]"),
    "gh_view": Table([
        Step(("", "1", "2"), r"^--| days ago\)", ON, "+"), Step(("3", "4"), r"^--| days ago\)", DROP, "4", ("hidden",)), Step(("4",), ANY, DROP),
    ], "[hid {hidden} comments]", "hidden"),
    "git_commit": Table([Step(None, r"^\s*(create mode |delete mode |rename |mode change |copy )", DROP, count=("hidden",))], "[{hidden} file-mode lines hidden]", "hidden"),
    "tree": _tree, "cargo_tree": _tree,
    "make": dropping(r"make\[\d+\]: (Entering|Leaving) directory|cc -c |g\+\+ -c |gcc -c |clang -c ", "echo and folder lines"),
    "mvn": dropping(r"\[INFO\] (Downloading from |Downloaded from |Progress )", "download lines"),
    "gradle": dropping(r"> Task :|Downloading https?://", "progress lines"),
    **{f"read {ext}": _read(re.escape(mark)) for ext, mark in COMMENTS.items()},
}
_ready = {name: [(set(s.when) if s.when is not None else None, re.compile(s.match), s) for s in t.steps] for name, t in TABLES.items()}


def fold(name: str, lines: list[str], exit_code: int | None) -> tuple[list[str], str | None]:
    """The lines a table keeps, and its trailer."""
    state, kept, counts = "", [], Counter()
    for line in lines:
        do = KEEP
        for when, match, step in _ready[name]:
            if (when is None or state in when) and match.search(line):
                counts.update(step.count)
                if step.then is not None:  # "+" is the next number
                    state = str(int(state or 0) + 1) if step.then == "+" else step.then
                if step.do != ON:
                    do = step.do
                    break
                if step.then == "+":
                    break
        if do == KEEP:
            kept.append(line)
    table = TABLES[name]
    if table.trailer is None or table.if_any and not counts[table.if_any]:
        return kept, None
    names = {n: counts[n] for s in table.steps for n in s.count}
    return kept, table.trailer.format(**names, exit="?" if exit_code is None else exit_code)


def as_it_is(args: list[str], text: str) -> bool:
    """Whether a search's output is no plain list of path:rest."""
    return text.lstrip().startswith("{") or any(
        a in SEARCH_AS_IT_IS or a.startswith(("--context=", "--after-context=", "--before-context=")) or re.match(r"-(?!-)\S*[ABC]", a) for a in args)


def matches(lines: list[str]) -> list[str]:
    """Lines path:rest by path, in first-seen order, each path once; long lines and long lists are cut, with a mark."""
    groups: dict[tuple[str, bool], list[str]] = {}
    for line in filter(None, lines):
        path, colon, rest = line.partition(":")
        if colon and path and ("/" in path or "." in path):
            groups.setdefault((path, True), []).append(rest)
        else:
            groups.setdefault((line, False), [])
    cut = lambda s: s if len(s) <= MOST_CHARS else s[:MOST_CHARS] + "…"
    out, shown, total = [], 0, sum(max(1, len(g)) for g in groups.values())
    for (key, parted), rests in groups.items():
        if shown >= MOST_MATCHES:
            break
        if not parted or len(rests) == 1:
            out.append(f"{key}:{cut(rests[0])}" if parted else cut(key))
            shown += 1
        else:
            some = rests[: MOST_MATCHES - shown]
            out += [f"{key}:", *(f"  {cut(r)}" for r in some)]
            shown += len(some)
    return [*out, f"[{total - shown} more matches]"] if total > shown else out


def _one(name: str, args: list[str], lines: list[str], exit_code: int | None) -> tuple[list[str], str | None]:
    if name in ("read_cat", "read_head_tail"):
        path = next((a for a in reversed(args) if not a.startswith("-") and not a.isdigit()), "")
        name = f"read {path.rpartition('.')[2]}"
    elif name == "rg":
        if not as_it_is(args, lines[0] if lines else ""):
            return matches(lines), None
        more = len(lines) - MOST_MATCHES
        return ([*lines[:MOST_MATCHES], f"… {more} more matches"] if more > 0 else lines), None
    return fold(name, lines, exit_code) if name in _ready else (lines, None)


def run(frames: DataFrame) -> DataFrame:
    """frames (filter_id, args, _ls, exit_code, ..) with _ls the kept lines, and _trailer."""
    names = frames.columns
    at = {c: names.index(c) for c in ("filter_id", "args", "_ls", "exit_code")}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(at[c]).to_pylist() for c in ("filter_id", "args", "_ls", "exit_code")), strict=True)
            done = [_one(name, [a for a in args or [] if a], ls or [], code) for name, args, ls, code in rows]
            columns = [pa.array([k for k, _ in done], b.column(j).type) if j == at["_ls"] else b.column(j) for j in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([t for _, t in done], pa.string())], names=[*names, "_trailer"])

    return frames.mapInArrow(work, T.StructType([*frames.schema.fields, T.StructField("_trailer", T.StringType())]))
