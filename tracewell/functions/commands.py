"""Shell-command expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell import rules as R

CHAIN = r"\s*(?:&&|\|\||;|\n)\s*"


def _words(part: Column) -> Column:
    return F.filter(F.split(F.trim(part), r"\s+"), lambda w: (w != "") & ~w.rlike(r"^\w+="))


def command_key(cmd: Column) -> Column:
    """Stable group name: the first working command, with its subcommand for multi-word tools."""
    c = F.regexp_replace(cmd, r"\\\n", " ")
    c = F.regexp_replace(F.trim(F.regexp_replace(c, r"(?m)^\s*#.*$", "")), r"^[({]\s*", "")
    parts = F.transform(F.split(c, r"\s*(?:&&|\|\||;|\||\n)\s*"), _words)
    work = F.filter(parts, lambda w: (F.size(w) > 0) & ~F.get(w, F.lit(0)).isin(R.SETUP_WORDS))
    words = F.get(work, F.lit(0))
    base = F.regexp_extract(F.regexp_replace(F.get(words, F.lit(0)), r"^[\"']|[\"']$", ""), r"([^/]*)$", 1)
    one, two = F.get(words, F.lit(1)), F.get(words, F.lit(2))
    python = base.rlike(r"^python3?$")
    named = (base.isin(R.MULTI_WORD_TOOLS) | python) & one.isNotNull() & ~one.startswith("-")
    runner = one.isin(R.TOOL_RUNNERS) & two.isNotNull() & ~two.startswith("-")
    return (
        F.when(words.isNull(), "(empty)")
        .when(named & runner, F.concat_ws(" ", base, one, two))
        .when(named, F.concat_ws(" ", base, one))
        .when(python & (one == "-m") & two.isNotNull(), F.concat_ws(" ", base, one, two))
        .otherwise(base)
    )


def command_parts(cmd: Column) -> Column:
    """Commands of a chain without a leading cd."""
    parts = F.transform(F.split(cmd, CHAIN), lambda p: F.regexp_replace(F.trim(p), r"^(cd\s+\S+\s*)", ""))
    return F.filter(parts, lambda p: p != "")


def is_lookup(tool: Column, cmd: Column) -> Column:
    """Read, Grep, Glob or a shell command that only reads."""
    reads = cmd.rlike(R.LOOKUP_COMMAND) & ~cmd.rlike(R.MUTATING_COMMAND)
    return tool.isin(R.LOOKUP_TOOLS) | ((tool == "Bash") & F.coalesce(reads, F.lit(False)))


def wants_content(cmd: Column) -> Column:
    return F.exists(command_parts(cmd), lambda p: p.rlike(R.CONTENT_COMMAND))


def check_command(cmd: Column, most: int | None = None) -> Column:
    """The test, build or lint command inside a line (of ``most`` characters, if given), without pipes and redirections."""
    bare = F.regexp_replace(cmd, r"^\s*cd\s+[^&;]+&&\s*", "")
    parts = F.transform(F.split(bare, r"\s*(?:&&|;)\s*"), lambda p: F.trim(F.regexp_replace(p, r"^(?:[A-Z_][A-Z0-9_]*=\S*\s+)+", "")))
    hit = F.get(F.filter(parts, lambda p: p.rlike(R.CHECK_COMMAND)), F.lit(0))
    clean = F.trim(F.regexp_replace(F.regexp_replace(hit, r"\s*\d?>&\d", ""), R.OUTPUT_TRIM, ""))
    usable = ~cmd.contains("\n") & (clean != "")
    if most is not None:
        usable = usable & (F.length(cmd) <= most)
    return F.when(usable, clean)


def doing_command(cmd: Column, most: int | None = None) -> Column:
    """What a line changed or verified (its first ``most`` characters, if given); null for looking around and heredocs."""
    bare = F.regexp_replace(cmd, r"^\s*cd\s+[^&;]+&&\s*", "")
    parts = F.transform(F.split(bare, r"\s*(?:&&|;)\s*"), lambda p: F.trim(p))
    parts = F.filter(parts, lambda p: (p != "") & ~p.rlike(R.READ_ONLY_COMMAND))
    line = F.regexp_replace(F.regexp_replace(F.array_join(parts, " && "), r"\s*\d?>&\d", ""), R.OUTPUT_TRIM, "")
    script = cmd.contains("\n") | cmd.contains("<<") | cmd.contains("$(cat")
    return F.when(~script & (F.size(parts) > 0), line if most is None else F.substring(line, 1, most))


def without_prose(cmd: Column) -> Column:
    """Heredoc bodies and quoted text with spaces removed, so words inside messages never count."""
    c = F.regexp_replace(cmd, r"(?s)<<-?\s*['\"]?(\w+)['\"]?([^\n]*)\n.*?(?:\n\s*\1\s*(?=\n|$)|$)", "$2")
    c = F.regexp_replace(c, r"'[^']*\s[^']*'", "''")
    return F.regexp_replace(c, r'"(?:[^"\\]|\\.)*\s(?:[^"\\]|\\.)*"', '""')


def risky_reason(cmd: Column, rules=R.RISKY_COMMANDS) -> Column:
    """First matching reason, or null."""
    line = without_prose(cmd)
    parts = F.transform(
        F.split(line, r"\n|;|&&|\|\||\|"),
        lambda p: F.regexp_replace(
            F.regexp_replace(F.trim(p), r"^(?:(?:\w+=\S*|sudo|command|exec|nohup|time|xargs|env|-\S+)\s+)+", ""), r"^\S*/(?=(?:rm|git)\s)", ""
        ),
    )
    # options of git itself, before its command
    parts = F.transform(parts, lambda p: F.regexp_replace(p, r"^git(?:\s+(?:-[cC]\s+\S+|--(?:git-dir|work-tree|namespace|exec-path|super-prefix|config-env)\s+\S+|-\S+))+\s+", "git "))
    whole = [F.when(({"raw": cmd, "line": line}[scope]).rlike(p), why) for why, scope, p in rules if scope != "part"]
    by_part = [(why, p) for why, scope, p in rules if scope == "part"]
    per_part = F.transform(parts, lambda s: F.coalesce(*[F.when(s.rlike(p), why) for why, p in by_part]))
    return F.coalesce(*whole, F.get(F.filter(per_part, lambda r: r.isNotNull()), F.lit(0)))


def shell_read(cmd: Column) -> Column:
    """struct(file, offset, limit) for a plain print of one file, else null."""
    c = F.trim(cmd)
    plain = ~F.regexp_replace(c, r"'[^']*'", "''").rlike(r"[|;&<>`$(){}\n\\]")
    cat = F.regexp_extract(c, r"^cat\s+(?:--\s+)?(['\"]?)([^\s'\"]+)\1$", 2)
    sed = r"^sed\s+-n\s+(['\"]?)(\d+),(\d+)p\1\s+(['\"]?)([^\s'\"]+)\4$"
    head = r"^head\s+-n\s*(\d+)\s+(['\"]?)([^\s'\"]+)\2$"
    a, b = F.regexp_extract(c, sed, 2).try_cast("bigint"), F.regexp_extract(c, sed, 3).try_cast("bigint")
    n = F.regexp_extract(c, head, 1).try_cast("bigint")
    none = F.lit(None).cast("bigint")
    shape = lambda f, o, m: F.struct(f.alias("file"), o.alias("offset"), m.alias("limit"))
    found = (
        F.when(cat != "", shape(cat, none, none))
        .when(b >= a, shape(F.regexp_extract(c, sed, 5), a, b - a + 1))
        .when(n.isNotNull(), shape(F.regexp_extract(c, head, 3), F.lit(1).cast("bigint"), n))
    )
    return F.when(plain & ~found["file"].rlike(R.MEDIA_FILE), found)
