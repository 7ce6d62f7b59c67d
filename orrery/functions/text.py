"""Column functions over paths, names, logs and provider answers."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Patterns, limits and name tables.
KEY_PATTERN = r"(sk-[A-Za-z0-9]{20,}|AIza[A-Za-z0-9_\-]{30,}|sk-ant-[A-Za-z0-9_\-]{20,}|[A-Za-z0-9]{40,})"
CHANGELOG_CHARS, ERROR_CHARS, JOB_ERROR_CHARS, PREVIEW_CHARS = 8000, 2000, 200, 1_000_000
SENTINEL = "UNABLE_TO_PATCH"
TRANSIENT = ("503", "429", "504", "unavailable", "deadline", "resource_exhausted")
LOCAL_HOSTS = r"^(localhost|127\.0\.0\.1)(:.*)?$"
NO_RUN = "[Warning] No verification run recorded for this patch."
BOTH_PASSED = "[Verified] Repo's own test suite and type-checker both passed on this patch."
TESTS_PASSED = "[Verified] Repo's own test suite passed on this patch (type-check not run / not configured)."
SANDBOX_PASSED = "[Verified] Isolated sandbox verification passed on this patch."
NO_TESTS = "[Warning] No test suite detected in this repo — this patch was validated by parse and type-check only, not by running tests."
RISKY = "[Warning] Possible semantic/behavior change — passing tests do not guarantee old behavior is preserved"
SAFE = "[Safe] Mechanical change"
REVIEW_LINE = "\n> [Review Required] Human review required before merge — see risk flag above.\n"
KNOWN_IMPORTS = {"beautifulsoup4": "bs4", "opencv-python": "cv2", "pillow": "PIL", "python-dateutil": "dateutil", "pyyaml": "yaml", "scikit-learn": "sklearn"}
TEST_DIRECTORIES = ("tests", "test", "__tests__", "spec", "specs")
TEST_NAMES = r"^test_|_test\.(py|go|rb)$|\.(test|spec)\.(ts|tsx|js|jsx)$|_spec\.rb$"
TEST_CLASSES = r"(?:^|[._-][Tt]est|[a-z0-9]Test)s?\.(?:java|cs)$"


def redacted(text) -> Column:
    return F.regexp_replace(text, KEY_PATTERN, "[REDACTED]")


def stripped(x) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def basename(path) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def depth(path) -> Column:
    return F.size(F.split(path, "/")) - 1


def extension(path) -> Column:
    """Lower-cased suffix with its dot; '' without one or for names that only begin with a dot."""
    return F.lower(F.regexp_extract(basename(path), r"[^.](\.[^.]*)$", 1))


def normalized(path: str) -> Column:
    """Slashes forward, ``.`` dropped, ``..`` applied, no leading slash."""
    step = f"""aggregate(filter(split(replace({path}, '\\\\', '/'), '/'), s -> s not in ('', '.')), cast(array() as array<string>),
        (a, s) -> if(s = '..' and size(a) > 0 and a[size(a) - 1] <> '..', slice(a, 1, size(a) - 1), concat(a, array(s))))"""
    return F.array_join(F.expr(step), "/")


def is_test_file(path: str) -> Column:
    raw = F.translate(F.col(path), "\\", "/")
    directories = F.slice(F.split(F.lower(raw), "/"), 1, F.size(F.split(raw, "/")) - 1)
    return F.arrays_overlap(directories, F.array(*map(F.lit, TEST_DIRECTORIES))) | F.lower(basename(raw)).rlike(TEST_NAMES) | basename(raw).rlike(TEST_CLASSES)


def package_name(name) -> Column:
    return F.lower(F.regexp_replace(name, "[-_.]+", "-"))


def import_names(name) -> Column:
    """Sorted names under which a Python distribution can be imported."""
    plain = package_name(name)
    known = F.create_map(*(F.lit(x) for pair in KNOWN_IMPORTS.items() for x in pair))
    return F.array_sort(F.array_distinct(F.array_compact(F.array(F.replace(plain, F.lit("-"), F.lit("_")), F.try_element_at(known, plain)))))


def content_hash(content) -> Column:
    return F.sha2(content, 256)


def registry_name(name) -> Column:
    """URL-encoded package name that keeps @ and /."""
    encoded = F.url_encode(name)
    for code, char in (("%40", "@"), ("%2F", "/"), ("+", "%20")):
        encoded = F.replace(encoded, F.lit(code), F.lit(char))
    return encoded


def iso_time(text) -> Column:
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))


def relative_time(text, now) -> Column:
    """Of an ISO time: seconds, minutes, hours or days ago, a date from 30 days on; ``recently`` without one, the first ten characters of a broken one or one without a zone."""
    at = F.when(F.regexp_like(text, F.lit(r"(Z|[+-]\d\d:?\d\d(:\d\d)?)$")), iso_time(text))
    age = F.unix_timestamp(now) - F.unix_timestamp(at)
    ago = lambda n, unit: F.concat(F.floor(n).cast("string"), F.lit(f"{unit} ago"))
    missing = F.coalesce(F.nullif(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit("recently"))
    return F.when(at.isNull(), F.when(missing == "recently", missing).otherwise(F.substring(text, 1, 10))).when(age < 60, ago(age, "s")).when(age < 3600, ago(age / 60, "m")).when(age < 86400, ago(age / 3600, "h")).when(age < 30 * 86400, ago(age / 86400, "d")).otherwise(F.date_format(at, "MMM dd, yyyy"))


def fenced_json(text) -> Column:
    """What a Markdown fence holds, else the text; trimmed."""
    inside = F.regexp_extract(text, r"(?s)```(?:json)?\s*\n?(.*?)```", 1)
    return stripped(F.when(inside != "", inside).otherwise(F.col(text) if isinstance(text, str) else text))


def extracted_changes(text) -> Column:
    """A provider's list of changes with defaults; null unless it is a JSON list."""
    schema = "array<struct<symbol_old:string,symbol_new:string,change_type:string,description:string,confidence:string>>"
    body = fenced_json(text)
    parsed = F.when(body.startswith("["), F.from_json(body, schema))
    return F.transform(
        parsed,
        lambda c: F.struct(
            F.coalesce(c["symbol_old"], F.lit("")).alias("symbol_old"), c["symbol_new"].alias("symbol_new"), F.coalesce(c["change_type"], F.lit("signature_change")).alias("change_type"),
            F.coalesce(c["description"], F.lit("")).alias("description"), F.coalesce(c["confidence"].try_cast("double"), F.lit(0.8)).alias("confidence"),
        ),
    )


def extracted_diff(text) -> Column:
    """The diff in a provider's answer, or the sentinel."""
    inside = F.regexp_extract(text, r"(?s)```(?:diff)?\s*\n(.*?)```", 1)
    plain = stripped(text)
    return F.when(F.contains(text, F.lit(SENTINEL)), SENTINEL).when(F.regexp_like(text, F.lit(r"(?s)```(?:diff)?\s*\n.*?```")), stripped(inside)).when(plain.rlike("^(---|@@|diff)"), plain).otherwise(SENTINEL)


def failure_class(text) -> Column:
    """transient, code_defect or unknown."""
    said = F.get_json_object(fenced_json(text), "$.classification")
    return F.when(said.isin("transient", "code_defect"), said).otherwise("unknown")


# What an answer without usable content stands for.
NO_CONTENT, NOT_JSON = "Provider returned no usable text content.", "Provider response was not valid JSON: "
RETRY_ONCE = "Treat as transient and retry once; escalate if it recurs."


def failure_answer(text) -> Column:
    """struct(classification, reasoning, recommended_action) of a provider's answer: a JSON object, if need be in a fence."""
    body = fenced_json(text)
    usable = body.startswith("{") & F.try_parse_json(body).isNotNull()
    said = lambda name: F.coalesce(F.get_json_object(body, f"$.{name}"), F.lit(""))
    row = lambda *cells: F.struct(*(c.alias(n) for c, n in zip(cells, ("classification", "reasoning", "recommended_action"), strict=True)))
    empty = F.coalesce(stripped(text), F.lit("")) == ""
    return (
        F.when(empty, row(F.lit("unknown"), F.lit(NO_CONTENT), F.lit(RETRY_ONCE)))
        .when(usable, row(failure_class(text), said("reasoning"), said("recommended_action")))
        .otherwise(row(F.lit("unknown"), F.concat(F.lit(NOT_JSON), F.substring(body, 1, 200)), F.lit(RETRY_ONCE)))
    )


def bounded(text, n: int) -> Column:
    """The first ``n`` characters, as changelogs and errors are kept."""
    return F.substring(text, 1, n)


def disclosure(has_run: Column, mode: Column, tests: Column, types: Column) -> Column:
    """What a patch's last run allows to say of it."""
    ok = lambda c: F.coalesce(c, F.lit(False))
    full = F.when(ok(tests) & ok(types), BOTH_PASSED).when(ok(tests), TESTS_PASSED).otherwise(SANDBOX_PASSED)
    return F.when(~ok(has_run), NO_RUN).when(ok(mode == "full"), full).otherwise(NO_TESTS)


def classification_table(change_type: Column, confidence: Column, risk: Column, scripts: Column | None = None, review: Column | None = None) -> Column:
    """The Markdown table of a pull request's change."""
    no = F.lit(False)
    rows = [
        ("Field", F.lit("Value")), ("---", None), ("Change type", change_type), ("Classifier confidence", F.concat(F.bround(confidence * 100, 0).cast("int").cast("string"), F.lit("%"))),
        ("Risk flag", F.when(risk, RISKY).otherwise(SAFE)), ("Install scripts", F.when(no if scripts is None else scripts, "allowed (opt-in)").otherwise("blocked (default)")),
    ]
    lines = [F.lit("|---|---|\n") if value is None else F.concat(F.lit(f"| {name} | "), value, F.lit(" |\n")) for name, value in rows]
    return F.concat(F.lit("## Change classification\n"), *lines, F.when(no if review is None else review, REVIEW_LINE).otherwise(""))


def pr_title(title, risk) -> Column:
    return F.when(risk & ~title.startswith("[semantic-risk]"), F.concat(F.lit("[semantic-risk] "), title)).otherwise(title)


def log_sha(log, kind: str) -> Column:
    """A commit noted in a log as ``[kind_sha:hex]``, else null."""
    return F.nullif(F.regexp_extract(log, rf"\[{kind}_sha:([a-f0-9]+)\]", 1), F.lit(""))


def squeezed(text) -> Column:
    """White space reduced to single spaces."""
    return stripped(F.regexp_replace(text, r"\s+", " "))


def redirect_allowed(url, hosts: tuple[str, ...]) -> Column:
    """Relative paths, local hosts, and http(s) urls whose host and port are listed; case does not count."""
    place = F.lower(F.try_parse_url(url, F.lit("AUTHORITY")))
    listed = place.rlike(LOCAL_HOSTS) | place.isin(*(h.lower() for h in hosts))
    return F.coalesce((url.startswith("/") & ~url.startswith("//")) | (F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https") & listed), F.lit(False))


def transient_error(text) -> Column:
    """Whether a provider's error is worth another try."""
    return F.lower(text).rlike("|".join(TRANSIENT))


def transient_delay(attempt: str) -> Column:
    """Seconds before try ``attempt`` + 1: doubling from 2."""
    return F.lit(2.0) * F.pow(F.lit(2.0), F.col(attempt) - 1)


def uuid_or_null(text) -> Column:
    """The canonical form of a UUID in any usual spelling, else null."""
    plain = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "urn:|uuid:", ""), r"^[{}]+|[{}]+$", ""), "-", ""))
    return F.when(plain.rlike("^[0-9a-f]{32}$"), F.regexp_replace(plain, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))


# Commands of the package managers, by manager: install, test, own type check, bare type check.
COMMANDS = {
    "pnpm": ("pnpm install --frozen-lockfile", "pnpm test", "pnpm run typecheck", "pnpm exec tsc --noEmit"),
    "yarn": ("yarn install --frozen-lockfile", "yarn test", "yarn typecheck", "yarn tsc --noEmit"),
    "npm": ("npm ci", "npm test", "npm run typecheck", "npx tsc --noEmit"),
}
NO_SCRIPTS = " --ignore-scripts"
NOT_INSTALLED = "echo 'Dependency installation skipped: allow_install_scripts is false (requires opt-in)'"


def environment(names: Column, package_json: Column, scripts_allowed: Column) -> Column:
    """How a repository is installed and checked, from its root file names and its package.json.

    A package.json that can be read decides, by lock file; else, if there is
    none, Python's files do; else it is taken for a npm project with all checks.
    """
    has = lambda *n: F.arrays_overlap(names, F.array(*map(F.lit, n)))
    named = ("ecosystem", "package_manager", "install_cmd", "test_cmd", "typecheck_cmd", "has_test", "has_typecheck")
    row = lambda *cells: F.struct(*((F.lit(c) if isinstance(c, (str, bool)) else c).alias(n) for n, c in zip(named, cells, strict=True)))
    test, own_types = F.get_json_object(package_json, "$.scripts.test"), F.get_json_object(package_json, "$.scripts.typecheck")
    install = lambda base: F.when(scripts_allowed, base).otherwise(base + NO_SCRIPTS)
    typed = has("tsconfig.json", "tsconfig.base.json")

    def node(manager: str) -> Column:
        base, run, own, bare = COMMANDS[manager]
        tested = F.coalesce(~F.contains(test, F.lit("no test specified")), F.lit(False))  # an empty script is one, too
        return row("node", manager, install(base), F.when(test.isNotNull(), run).otherwise("npm test"), F.when(~typed, "").when(own_types.isNotNull(), own).otherwise(bare), tested, typed)

    pip = F.when(~scripts_allowed, NOT_INSTALLED).when(has("requirements.txt"), "pip install -r requirements.txt").otherwise("pip install -e .")
    python = row("python", "pip", pip, "pytest", F.when(has("mypy.ini"), "mypy .").otherwise(""), True, has("mypy.ini"))
    default = row("node", "npm", install(COMMANDS["npm"][0]), COMMANDS["npm"][1], COMMANDS["npm"][3], True, True)
    readable = has("package.json") & F.get_json_object(package_json, "$").isNotNull()
    return F.when(readable & has("pnpm-lock.yaml"), node("pnpm")).when(readable & has("yarn.lock"), node("yarn")).when(readable, node("npm")).when(~has("package.json") & has("pyproject.toml", "requirements.txt"), python).otherwise(default)


@F.pandas_udf(T.BooleanType())
def signature_valid(body: pd.Series, header: pd.Series, secret: pd.Series) -> pd.Series:
    """HMAC-SHA256 of a webhook body; a missing secret, header or prefix fails."""

    def one(b, h, s) -> bool:
        if not b or not h or not s or not h.startswith("sha256="):
            return False
        return hmac.compare_digest(hmac.new(s.encode(), bytes(b), hashlib.sha256).hexdigest(), h[7:])

    return pd.Series([one(*x) for x in zip(body, header, secret, strict=True)], dtype=bool)


@F.pandas_udf(T.DoubleType())
def round3(x: pd.Series) -> pd.Series:
    """Three decimals on the exact binary value, half to even."""
    return x.map(lambda v: None if pd.isna(v) else round(float(v), 3))
