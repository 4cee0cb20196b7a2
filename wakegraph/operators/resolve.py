"""Ordered first-match resolution: candidates of all tiers are united, and the best tier of each input is kept."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakegraph.functions import names


def best_tier(candidates: DataFrame, key: Sequence[str], tier: str = "tier") -> DataFrame:
    """The candidates of each key's least tier."""
    least = candidates.groupBy(*key).agg(F.min(tier).alias("__least"))
    return candidates.join(least, list(key)).where(F.col(tier) == F.col("__least")).drop("__least")


def resolve_calls(sites: DataFrame, methods: DataFrame, ancestors: DataFrame) -> DataFrame:
    """(site, target, kind) of call sites (site, owner, simple, arity).

    Targets are the owner's methods of that name and arity; else those with fewer parameters; else the same two tiers
    over the owner's ancestors (child, ancestor); else the placeholder owner.simple(?). One target is `static` or
    `virtual`, n targets are `ambiguous-of-n` each, placeholders `unresolved-arity` if the owner has the name, else
    `unresolved`. methods: fqn, owner, simple, n_params, is_static; sites with null owner or name don't come out.
    """
    known = methods.where("n_params is not null").select("fqn", "owner", "simple", "n_params", "is_static").distinct()
    sites = sites.where("owner is not null and simple is not null")
    fits = F.when(F.col("n_params") == F.col("arity"), 1).when(F.col("n_params") <= F.col("arity"), 2)
    own = sites.join(known, ["owner", "simple"]).select("site", "fqn", "is_static", fits.alias("tier"))
    above = (
        sites.join(ancestors.select(F.col("child").alias("owner"), F.col("ancestor")), "owner")
        .join(known.withColumnRenamed("owner", "ancestor"), ["ancestor", "simple"]).select("site", "fqn", "is_static", (fits + 2).alias("tier"))
    )
    hits = best_tier(own.unionByName(above).where("tier is not null").distinct(), ["site"])
    n = F.count(F.lit(1)).over(Window.partitionBy("site"))
    kind = F.when(n > 1, F.concat(F.lit("ambiguous-of-"), n)).when(F.col("is_static"), "static").otherwise("virtual")
    found = hits.select("site", F.col("fqn").alias("target"), kind.alias("kind"))
    named = known.select("owner", "simple").distinct().withColumn("has", F.lit(True))
    missing = (
        sites.join(hits.select("site").distinct(), "site", "left_anti").join(named, ["owner", "simple"], "left")
        .select("site", F.concat("owner", F.lit("."), "simple", F.lit("(?)")).alias("target"), F.when(F.col("has"), "unresolved-arity").otherwise("unresolved").alias("kind"))
    )
    return found.unionByName(missing)


def overrides(methods: DataFrame, ancestors: DataFrame) -> DataFrame:
    """(src, dst): a method and the method of an ancestor with its name and compatible parameter types.

    methods: fqn, owner, simple, types; ancestors: child, ancestor. Constructors override nothing. Joined on ancestor,
    name and arity; `?` stands for any type.
    """
    m = methods.where("simple <> '<init>' and types is not null").select("fqn", "owner", "simple", "types", F.size("types").alias("arity")).distinct()
    below = m.join(ancestors.select(F.col("child").alias("owner"), "ancestor"), "owner").select(F.col("fqn").alias("src"), "ancestor", "simple", "arity", F.col("types").alias("a"))
    above = m.select(F.col("fqn").alias("dst"), F.col("owner").alias("ancestor"), "simple", "arity", F.col("types").alias("b"))
    return below.join(above, ["ancestor", "simple", "arity"]).where(names.types_compatible(F.col("a"), F.col("b"))).select("src", "dst").distinct()


def nearest_inherited(wanted: DataFrame, methods: DataFrame, ancestors: DataFrame) -> DataFrame:
    """(owner, simple, fqn): the method of that name in the nearest generation of ancestors, the least name in it.

    wanted: owner, simple; methods: fqn, owner, simple; ancestors: child, ancestor, depth.
    """
    hits = (
        wanted.distinct().join(ancestors.select(F.col("child").alias("owner"), "ancestor", "depth"), "owner")
        .join(methods.select("fqn", F.col("owner").alias("ancestor"), "simple"), ["ancestor", "simple"])
    )
    return hits.groupBy("owner", "simple").agg(F.min_by("fqn", F.struct("depth", "fqn")).alias("fqn"))


def enclosing_class(scopes: DataFrame, classes: DataFrame) -> DataFrame:
    """(scope, class_fqn): the longest dotted prefix of a scope, itself included, that is a class; null if none is."""
    parts = F.split("scope", r"\.")
    prefixes = scopes.select("scope").where("scope is not null").distinct().select(
        "scope", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))).alias("class_fqn")
    )
    hits = prefixes.join(classes.select("class_fqn").distinct(), "class_fqn")
    longest = hits.groupBy("scope").agg(F.max_by("class_fqn", F.length("class_fqn")).alias("class_fqn"))
    return scopes.select("scope").where("scope is not null").distinct().join(longest, "scope", "left")


def import_cascade(uses: DataFrame, imports: DataFrame, classes: DataFrame) -> DataFrame:
    """(file, name, class_fqn, rule) of simple type names used in files.

    uses: file, pkg, name; imports: file, target (a class or `pkg.*`); classes: class_fqn, simple, pkg. Tried in order:
    explicit import; the only wildcard import that has the name; the own package; java.lang for its usual names; none.
    """
    lang = F.col("name").isin("String", "Object", "Integer", "Long", "Boolean", "Double", "StringBuilder", "Exception", "RuntimeException", "Override", "Iterable", "Math", "System", "Thread", "Runnable")
    u = uses.distinct()
    exact = u.join(imports.where(~F.col("target").endswith(".*")).select("file", F.col("target").alias("class_fqn"), names.simple_name(F.col("target")).alias("name")), ["file", "name"]).select("file", "name", "class_fqn", F.lit(1).alias("tier"))
    stars = imports.where(F.col("target").endswith(".*")).select("file", F.regexp_replace("target", r"\.\*$", "").alias("pkg2"))
    wild = (
        u.join(stars, "file").join(classes.select("class_fqn", F.col("simple").alias("name"), F.col("pkg").alias("pkg2")), ["name", "pkg2"])
        .groupBy("file", "name").agg(F.count_distinct("class_fqn").alias("n"), F.min("class_fqn").alias("class_fqn")).where("n = 1").select("file", "name", "class_fqn", F.lit(2).alias("tier"))
    )
    same = u.join(classes.select("class_fqn", F.col("simple").alias("name"), "pkg"), ["name", "pkg"]).select("file", "name", "class_fqn", F.lit(3).alias("tier"))
    java = u.where(lang).select("file", "name", F.concat(F.lit("java.lang."), "name").alias("class_fqn"), F.lit(4).alias("tier"))
    raw = u.select("file", "name", F.col("name").alias("class_fqn"), F.lit(5).alias("tier"))
    rule = F.element_at(F.array(*[F.lit(x) for x in ("import", "wildcard", "package", "java.lang", "raw")]), F.col("tier"))
    hits = best_tier(exact.unionByName(wild).unionByName(same).unionByName(java).unionByName(raw), ["file", "name"])
    return hits.groupBy("file", "name").agg(F.min("class_fqn").alias("class_fqn"), F.min("tier").alias("tier")).select("file", "name", "class_fqn", rule.alias("rule"))


def fuzzy_methods(inputs: DataFrame, methods: DataFrame) -> DataFrame:
    """(input, fqn, tier): exact names first, else all methods of the same owner, name and number of parameters.

    inputs: input (a written method name; spaces are ignored); methods: fqn, owner, simple, n_params. A constructor may
    be written `Owner.Owner(..)`. Inputs without a hit don't come out.
    """
    clean = F.regexp_replace("input", r"\s+", "")
    i = inputs.where("input is not null").select("input").distinct().withColumn("clean", clean)
    exact = i.join(methods.select("fqn").distinct(), F.col("clean") == F.col("fqn")).select("input", "fqn", F.lit(1).alias("tier"))
    simple = F.regexp_extract("clean", r"([^.(]+)(?:\(.*)?$", 1)
    owner = F.regexp_extract("clean", r"^([^(]*)\.[^.(]+(?:\(.*)?$", 1)
    parts = i.withColumn("owner", owner).withColumn("simple", F.when(simple == names.simple_name(owner), "<init>").otherwise(simple)).withColumn("n_params", names.parameter_count(F.col("clean")))
    near = parts.join(methods.select("fqn", "owner", "simple", "n_params").distinct(), ["owner", "simple", "n_params"]).select("input", "fqn", F.lit(2).alias("tier"))
    return best_tier(exact.unionByName(near), ["input"])


def strategy_table(calls: DataFrame) -> DataFrame:
    """(strategy, n, average, percent, place) of calls(strategy, took): most frequent first, by name among equals.

    One row a strategy is ranked; the calls themselves are aggregated before.
    """
    counted = calls.groupBy("strategy").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("took"), 6).alias("average"))
    whole = Window.partitionBy(F.lit(1))
    percent = F.round(100.0 * F.col("n") / F.sum("n").over(whole), 6)
    return counted.select("strategy", "n", "average", percent.alias("percent"), F.row_number().over(whole.orderBy(F.desc("n"), "strategy")).alias("place"))


# Packages of library types that are named without an import of their own.
LIBRARY = {
    "java.lang": (
        "String Object Integer Long Boolean Double Float Byte Short Character Number Math System Thread Throwable Exception RuntimeException Error Class Void"
        " Iterable Comparable CharSequence StringBuilder StringBuffer"
    ),
    "java.util": (
        "HashMap LinkedHashMap TreeMap Map AbstractMap ArrayList LinkedList List AbstractList Vector Stack HashSet LinkedHashSet TreeSet Set AbstractSet Collection"
        " AbstractCollection Iterator Enumeration Hashtable Properties Date Calendar Optional Arrays Collections Objects Comparator UUID"
    ),
    "java.io": "File InputStream OutputStream Reader Writer BufferedReader BufferedWriter FileReader FileWriter FileInputStream FileOutputStream PrintStream PrintWriter IOException Serializable",
    "java.util.concurrent": "ConcurrentHashMap ConcurrentMap ExecutorService Executors Future Callable TimeUnit",
    "javax.servlet.http": "HttpServlet HttpServletRequest HttpServletResponse HttpSession Cookie",
    "javax.servlet": "ServletException ServletContext ServletConfig",
    "org.json": "JSONObject JSONArray JSONException",
    "java.text": "MessageFormat SimpleDateFormat DateFormat",
    "java.util.logging": "Logger Level",
}
NAME_RULES = ("import", "library wildcard", "only wildcard", "library", "package", "raw")


def library_names() -> list[tuple[str, str]]:
    """(simple name, package) of LIBRARY."""
    return [(name, pkg) for pkg, names_ in LIBRARY.items() for name in names_.split()]


def imported_names(uses: DataFrame, imports: DataFrame) -> DataFrame:
    """(file, name, class_fqn, rule) of simple type names by the imports of their file alone, whether or not the class is known.

    uses: file, pkg, name; imports: file, target (a class or `pkg.*`). Tried in order: an import of the name; a wildcard
    import of the package that the library has the name in; the only wildcard import of the file; the library; the own
    package; the name as it is. All but the first and the last are for names that begin with a capital.
    """
    u = uses.where("name is not null").distinct()
    capital = u.where(F.col("name").rlike("^[A-Z]"))
    # as many rows as LIBRARY has names
    library = u.sparkSession.createDataFrame(library_names(), "name string, lib string").hint("broadcast")
    row = lambda df, pkg, tier: df.select("file", "name", F.concat(pkg, F.lit("."), "name").alias("class_fqn"), F.lit(tier).alias("tier"))
    exact = imports.where(~F.col("target").endswith(".*")).select("file", F.col("target").alias("class_fqn"), names.simple_name(F.col("target")).alias("name"))
    stars = imports.where(F.col("target").endswith(".*")).select("file", F.regexp_replace("target", r"\.\*$", "").alias("star")).distinct()
    single = stars.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min("star").alias("star")).where("n = 1")
    known = capital.join(library, "name")
    hits = (
        u.join(exact, ["file", "name"]).select("file", "name", "class_fqn", F.lit(1).alias("tier"))
        .unionByName(row(known.join(stars.withColumnRenamed("star", "lib"), ["file", "lib"], "left_semi"), F.col("lib"), 2))
        .unionByName(row(capital.join(single, "file"), F.col("star"), 3)).unionByName(row(known, F.col("lib"), 4)).unionByName(row(capital.where("pkg <> ''"), F.col("pkg"), 5))
        .unionByName(u.select("file", "name", F.col("name").alias("class_fqn"), F.lit(6).alias("tier")))
    )
    best = hits.groupBy("file", "name").agg(F.min(F.struct("tier", "class_fqn")).alias("b"))
    return best.select("file", "name", "b.class_fqn", F.element_at(F.array(*[F.lit(r) for r in NAME_RULES]), F.col("b.tier")).alias("rule"))
