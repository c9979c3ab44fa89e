"""Commands of hosts: listing, help and resolution of command lines, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import script
from lectern.functions import text as t
from lectern.operators import selectors as sel


def leading_comment(source: Column | str) -> Column:
    """First sentence of a script's first block comment, '' without one."""
    return F.coalesce(t.first_sentence(t.format_comment(F.try_element_at(script.comments_of(source), F.lit(1))["raw"])), F.lit(""))


def command_list(scripts: DataFrame, key: str) -> DataFrame:
    """key (of another name than these), ord, path (the words that call it, none for the default export), label, doc of scripts(key, source)."""
    c = scripts.select(key, F.posexplode(script.commands_of("source")).alias("ord", "c"))
    return c.select(key, "ord", F.col("c.path").alias("path"), sel.label("c.path").alias("label"), t.format_comment("c.raw").alias("doc"))


def help_text(label: Column | str, doc: Column | str) -> Column:
    """A command's lines of help: its words, and its comment set in."""
    label, doc = (F.col(x) if isinstance(x, str) else x for x in (label, doc))
    lines = F.transform(F.split(doc, "\n"), lambda x: F.regexp_replace(F.concat(F.lit("    "), x), r"\s+$", ""))
    return F.concat(F.lit("  "), label, F.lit("\n"), F.when(F.coalesce(doc, F.lit("")) == "", F.lit("    (no comment)")).otherwise(F.array_join(lines, "\n")))


def trie(commands: DataFrame) -> DataFrame:
    """id, prefix, leaf, takes of commands(id, ord, path): every beginning of a path; whether it is a command itself, and
    the words that can follow it, in the commands' order."""
    each = commands.select("id", "ord", "path", F.explode(F.sequence(F.lit(0), F.size("path"))).alias("n"))
    follows = F.when(F.col("n") < F.size("path"), F.struct("ord", F.try_element_at("path", F.col("n") + 1).alias("word")))
    words = F.array_distinct(F.array_sort(F.collect_list(follows))["word"])
    return each.groupBy("id", F.slice("path", 1, F.col("n")).alias("prefix")).agg(F.bool_or(F.col("n") == F.size("path")).alias("leaf"), words.alias("takes"))


#: Outcomes of a command line.
RUN, HELP, NO_HOST, NO_COMMANDS, NO_COMMAND, NEEDS_VERB, NO_VERB = "run", "help", "unknown-host", "no-commands", "unknown-command", "needs-verb", "unknown-verb"


def resolve(requests: DataFrame, hosts: DataFrame, commands: DataFrame) -> DataFrame:
    """request, status, outcome, label, rest, flags, takes of requests(request, id, argv) over hosts(id) and commands(id, ord, path).

    argv is what follows the host's id. Its first word, and then its positionals, are looked up in the trie of the
    host's commands; the longest beginning that is there counts, so one join answers all requests. label: its words;
    rest: positionals after it; takes: words that could have followed. The default export runs without a word or
    before a flag that doesn't ask for help; without one, help is shown and counts as an error.
    """
    first = F.try_element_at("argv", F.lit(1))
    flag = first.isNull() | first.startswith("-")
    parsed = t.parse_args(F.when(flag, F.col("argv")).otherwise(F.slice("argv", 2, F.greatest(F.size("argv"), F.lit(1)))))
    r = requests.select("request", "id", F.coalesce(first.isin("--help", "-h"), F.lit(False)).alias("asks"), flag.alias("flag"), first.alias("first"), parsed.alias("a"))
    r = r.withColumn("words", F.when(F.col("flag"), F.array().cast("array<string>")).otherwise(F.concat(F.array("first"), "a.pos")))
    tried = r.select("request", "id", F.explode(F.transform(F.sequence(F.lit(0), F.size("words")), lambda n: F.struct(n.alias("n"), F.slice("words", F.lit(1), n).alias("prefix")))).alias("x"))
    known = tried.select("request", "id", "x.n", "x.prefix").join(trie(commands), ["id", "prefix"])
    best = known.groupBy("request").agg(F.max_by(F.struct("n", "leaf", "takes"), "n").alias("best"), F.bool_or((F.col("n") == 0) & F.col("leaf")).alias("default"))
    rows = r.join(hosts.select("id", F.lit(True).alias("host")).distinct(), "id", "left").join(best, "request", "left")
    n, words = F.col("best.n"), F.size("words")
    outcome = (
        F.when(F.col("host").isNull(), NO_HOST).when(F.col("best").isNull(), NO_COMMANDS).when(F.col("asks"), HELP)
        .when(F.col("flag"), F.when(F.col("default"), RUN).otherwise(HELP)).when(n == 0, NO_COMMAND)
        .when(F.col("best.leaf"), RUN).when(n == words, NEEDS_VERB).otherwise(NO_VERB)
    )
    at = F.when(F.col("flag"), F.lit(0)).otherwise(F.coalesce(n, F.lit(0)))
    rest = F.when(F.col("flag"), F.col("a.pos")).otherwise(F.slice("words", at + 1, F.greatest(words, F.lit(1))))
    rows = rows.withColumn("outcome", outcome)
    fine = (F.col("outcome") == RUN) | (F.col("outcome") == HELP) & F.col("asks")
    label = sel.label(F.slice("words", 1, at))
    return rows.select("request", F.when(fine, 0).otherwise(1).alias("status"), "outcome", label.alias("label"), rest.alias("rest"), F.col("a.flags").alias("flags"), F.coalesce("best.takes", F.array().cast("array<string>")).alias("takes"))


def seed_plan(paths: DataFrame, existing: DataFrame) -> DataFrame:
    """path, action of paths that a fresh corpus gets and existing(path) doesn't hold: rewrite documents, copy the rest."""
    return paths.join(existing.select("path"), "path", "left_anti").select("path", F.when(F.col("path").endswith(".html"), "rewrite").otherwise("copy").alias("action"))
