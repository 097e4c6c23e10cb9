"""Running rules over groups of sources: options and what may go together, the run itself, lists of rules.

The same run serves every way in: a command line (``python -m tesserae.operators.batch``), a compiler's hook
that leaves a diff beside the classes, a build tool that hands over its settings as arguments, or a call.
"""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.text import split_arguments
from tesserae.operators import report, rules
from tesserae.operators.rules import Rule

#: Options with a value, and those without (fixed names).
VALUED = ("hint", "hint-file", "config", "config-file", "group", "out", "source", "classpath", "sourcepath", "bootclasspath", "cache")
FLAGS = ("apply", "no-apply", "list", "run-tests", "fail-on-warnings", "progress", "debug", "show-gui", "help")
SOURCE_LEVEL = re.compile(r"(1\.)?[2-9][0-9]*|[12][0-9]")
UPGRADE = "META-INF/upgrade/upgrade.diff"


class UsageError(ValueError):
    """Options that do not go together; the run would end with 1."""


@dataclass
class Options:
    values: dict[str, list[str]] = field(default_factory=dict)
    flags: set[str] = field(default_factory=set)
    roots: list[str] = field(default_factory=list)

    def one(self, name: str) -> str | None:
        return self.values[name][-1] if name in self.values else None


def options(*args: str) -> Options:
    """Options of a command line, checked."""
    out, todo = Options(), list(args)
    while todo:
        x = todo.pop(0)
        if not x.startswith("--"):
            out.roots.append(x)
            continue
        name, eq, value = x[2:].partition("=")
        if name in FLAGS and not eq:
            out.flags.add(name)
        elif name in VALUED:
            if not eq:
                if not todo:
                    raise UsageError(f"--{name} needs a value")
                value = todo.pop(0)
            out.values.setdefault(name, []).append(value)
        else:
            raise UsageError(f"{x} is not a recognized option")
    check(out)
    return out


def check(o: Options) -> None:
    """Which options exclude each other."""
    if "config-file" in o.values:
        for other in ("hint", "hint-file"):
            if other in o.values:
                raise UsageError(f"cannot specify --{other} and --config-file together")
    if "hint" in o.values and "hint-file" in o.values:
        raise UsageError("cannot specify --hint and --hint-file together")
    if "config" in o.values and "hint" not in o.values:
        raise UsageError("--config cannot specified when no hint is specified")
    for c in o.values.get("config", []):
        if "=" not in c:
            raise UsageError(f"configuration option is missing '=' ({c})")
    level = o.one("source")
    if level is not None and not SOURCE_LEVEL.fullmatch(level):
        raise UsageError(f"unrecognized source level specification: {level}")


def exact_remote(capabilities: set[str], known: list[Rule], imports: int = 0) -> bool:
    """Whether a remote index can give exact spans: it says that it has types and spans, and every rule is a plain pattern without imports.

    Otherwise its answers are candidates, which are matched again here.
    """
    return {"attributed", "spans"} <= capabilities and imports == 0 and all(r.enabled and r.pattern for r in known)


def group_options(text: str) -> Options:
    """Roots and paths of one group, as one argument whose words may be escaped."""
    return options(*split_arguments(text))


def chosen(known: list[Rule], o: Options, config: dict[str, bool] | None = None, run_declarative: bool = True) -> list[Rule]:
    """The rules that options and a configuration leave."""
    if o.one("hint") is not None:
        return rules.effective(known, {}, only=o.one("hint"))
    return rules.effective(known, config or {}, run_declarative)


def listed(known: list[Rule]) -> list[str]:
    """The names of all rules, each once, in order."""
    return sorted({r.label for r in known})


def display_names(spark: SparkSession, known: list[Rule]) -> DataFrame:
    """id and display name of every rule."""
    return spark.createDataFrame(sorted({("text/x-java:" + re.sub(r"\s+", "-", r.label), r.label) for r in known}), "id string, display_name string")


@dataclass
class Result:
    """What a run found: tables, and the code it ends with."""

    status: DataFrame
    found: DataFrame
    changed: DataFrame | None
    warnings_fail: bool = False

    def exit_code(self) -> int:
        worst = {r.status for r in self.status.select("status").distinct().collect()}  # four at most
        if self.warnings_fail and not self.found.isEmpty():
            return 1
        return 1 if "FAILURE" in worst else 0

    def overall(self) -> str:
        seen = {r.status for r in self.status.select("status").distinct().collect()}
        return max(seen, key=report.STATUS.index, default="NOTHING_TO_DO")


def run(files: DataFrame, known: list[Rule], o: Options, config: dict[str, bool] | None = None, configured_apply: bool | None = None) -> Result:
    """Rules over files (group, path, content): occurrences, or rewritten files with their diffs, and a status for each group.

    Only the groups that options name are worked on, all if they name none; every group's status is the greatest of its files'.
    """
    some = chosen(known, o, config)
    groups = o.values.get("group", [])
    mine = files.filter(F.col("group").isin(*groups)) if groups else files
    apply = rules.should_apply("no-apply" in o.flags, "apply" in o.flags, configured_apply)
    found = rules.occurrences(mine, some) if some else mine.sparkSession.createDataFrame([], "path string, label string, severity string, start_off long, end_off long, line long, column long")
    changed = rules.applied(mine, some) if apply and some else None
    return Result(rules.group_status(mine, some), found, changed, "fail-on-warnings" in o.flags)


def diagnostics(result: Result, files: DataFrame) -> DataFrame:
    """path, line, column, severity and text of each occurrence, as a compiler prints it."""
    lines = files.select("path", F.posexplode(F.split("content", "\n", -1)).alias("l", "text")).withColumn("line", F.col("l").cast("long") + 1).drop("l")
    met = result.found.join(lines, ["path", "line"])
    mark = F.regexp_replace("label", "[^A-Za-z0-9]+", "_")
    head = F.concat_ws("", F.col("path"), F.lit(":"), F.col("line").cast("string"), F.lit(": "), F.col("severity"), F.lit(": ["), mark, F.lit("] "), F.col("label"))
    caret = F.concat(F.regexp_replace(F.expr("substring(text, 1, int(column) - 1)"), r"[^\t]", " "), F.lit("^"))
    return met.select("path", "line", "column", "severity", F.concat_ws("\n", head, "text", caret).alias("message"))


def upgrade(result: Result, folder: str) -> None:
    """Leave the diffs of a run in one file below a folder, files in order."""
    if result.changed is None:
        raise ValueError("nothing was applied")
    result.changed.select("path", "diff").orderBy("path").select("diff").coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(f"{folder.rstrip('/')}/{UPGRADE}")


def compute(spark: SparkSession, sources: dict[str, str], known: list[Rule]) -> dict[str, list[tuple[str, int, int]]]:
    """For a few sources at hand: path to (rule, start, end) of every occurrence. Nothing is sent to executors."""
    out = {}
    for path, code in sources.items():
        m = rules.Matcher(code)
        out[path] = sorted((r.label, a, b) for r in known if r.enabled for a, b, _ in rules.find(r, m))
    return out


def arguments(settings: dict) -> list[str]:
    """The command line for a build tool's settings: lists repeat their option, true stands for a flag, roots come last."""
    out = []
    for k, v in settings.items():
        if k == "roots":
            continue
        if v is True:
            out.append(f"--{k}")
        elif isinstance(v, (list, tuple)):
            out += reduce(lambda a, x: [*a, f"--{k}", str(x)], v, [])
        elif v not in (None, False, ""):
            out += [f"--{k}", str(v)]
    options(*out)
    return [*out, *settings.get("roots", [])]


def unused_imports(code: str) -> str:
    """A source without single-type imports that nothing in it names."""
    from tesserae.operators import syntax

    body = re.sub(r"^\s*import\b[^;]*;", "", code, flags=re.M)
    used = {t.text for t in syntax.tokens(body) if t.kind == "name"} | set(re.findall(r"[{@]\w+\s+([A-Z]\w*)", body))

    def keep(m: re.Match) -> str:
        name = m[2].rpartition(".")[2]
        return m[0] if name == "*" or name in used else ""

    return re.sub(r"^[ \t]*import\s+(static\s+)?([\w.]+(?:\.\*)?)\s*;[ \t]*\n?", keep, code, flags=re.M)


def main(args: list[str]) -> int:
    """List rules, run their tests, or find and apply them below roots."""
    try:
        o = options(*args)
    except UsageError as e:
        print(e, file=sys.stderr)
        return 1
    if "help" in o.flags:
        print("options: " + " ".join([*(f"--{x} VALUE" for x in VALUED), *(f"--{x}" for x in FLAGS)]))
        return 0
    text = open(o.one("hint-file"), encoding="utf-8").read() if o.one("hint-file") else ""
    known, wrong = rules.read(text)
    for w in wrong:
        print(f"[rule_error] {w}", file=sys.stderr)
    if "list" in o.flags:
        print("\n".join(listed(known)))
        return 0
    failed = rules.run_tests(text) if "run-tests" in o.flags else []
    for f in failed:
        print(f, file=sys.stderr)
    if not o.roots:
        print("no source roots to work on", file=sys.stderr)
        return 1 if failed or wrong else 0
    from tesserae.sources import corpus

    spark = SparkSession.builder.getOrCreate()
    files = reduce(lambda a, b: a.unionByName(b), [corpus.read_tree(spark, r, "*.java").select(F.lit(r).alias("group"), F.concat_ws("/", F.lit(r.rstrip("/")), "relative_path").alias("path"), "content") for r in o.roots])
    result = run(files, known, o)
    for row in diagnostics(result, files).orderBy("path", "line", "column").toLocalIterator():
        print(row.message)
    if result.changed is not None and o.one("out"):
        upgrade(result, o.one("out"))
    return 1 if failed or wrong else result.exit_code()


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
