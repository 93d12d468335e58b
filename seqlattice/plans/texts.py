"""Queries over the words of documents, benchmark items and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import alignment, colours, marked, morphology, patterns, prosody, syllables, tiers
from ..functions.inventory import CLASS_OF, CODA_PAIRS, CODE, CONSONANTS, CONSTRAINTS, DIGRAPHS, FUSION, MEMBERS, NUCLEUS_PAIRS, ONSET_PAIRS, PHONEMES, SPELLING, TOKEN, VOWELS, clusters, cv_code, encoded, split
from ..operators import baselines, blind, constraints, distributions, ngrams, onsets, reports, rewriting
from ..sources.storage import cut
from ..sources.tables import lexicon, spoken, table, vocabulary, words_of


def _spread(words: DataFrame) -> DataFrame:
    """Distinct words over all tasks: few bytes, but each costs a Python call."""
    return words.repartition(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), "word")


def word_rank_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = distributions.rank_stats(lexicon(spark, sf_dir).withColumnRenamed("word", "symbol"), "lang")
    return stats.select("lang", "n_types", "n_tokens", *(F.round(c, 6).alias(c) for c in ("top_share", "top1", "h_bits", "h_rel")), F.round("p_geo", 9).alias("p_geo"))


def lang_js_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = lexicon(spark, sf_dir)
    letters = words.select("lang", F.explode(F.split("word", "")).alias("symbol"), "n").groupBy("lang", "symbol").agg(F.sum("n").alias("n"))
    out = distributions.js_divergence(letters, "lang").withColumn("unit", F.lit("letter"))
    return out.unionByName(distributions.js_divergence(words.withColumnRenamed("word", "symbol"), "lang").withColumn("unit", F.lit("word"))).select("unit", "left", "right", F.round("js", 6).alias("js"))


def lang_summary_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios of each language, by sounds of the words that the inventory can spell."""
    code = F.col("code")

    def share(members: tuple[str, ...] | list[str]) -> Column:
        return F.length(F.regexp_replace(code, "[^" + "".join(CODE[p] for p in members) + "]", "")) * F.col("n")

    rows = lexicon(spark, sf_dir).filter(F.concat_ws("", F.regexp_extract_all("word", F.lit(TOKEN), F.lit(1))) == F.col("word")).withColumn("code", encoded(F.col("word")))
    obstruents = MEMBERS["O"]
    voiced = [p for p in obstruents if PHONEMES[p]["voi"]]
    sums = rows.groupBy("lang").agg(F.sum("n").alias("words"), F.sum(F.length(code) * F.col("n")).alias("seg"), F.sum(share(VOWELS)).alias("v"), F.sum(share(obstruents)).alias("o"), F.sum(share(voiced)).alias("vo"), F.sum(share(MEMBERS["R"])).alias("r"))
    return sums.select("lang", "words", F.round(F.col("v") / F.col("seg"), 6).alias("vowel_share"), F.round(F.col("vo") / F.col("o"), 6).alias("voiced_share"), F.round(F.col("r") / (F.col("seg") - F.col("v")), 6).alias("sonorant_share"), F.round(F.col("seg") / F.col("words"), 6).alias("mean_length"))


def cv_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spoken(spark, sf_dir).select(F.explode(clusters(F.col("word"))).alias("symbol"), "n")
    return runs.filter(F.length(encoded(F.col("symbol"))) > 1).groupBy("symbol").agg(F.sum("n").alias("n"))


def cv_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skeletons of C and V, by words."""
    return spoken(spark, sf_dir).groupBy(cv_code(F.col("word")).alias("skeleton")).agg(F.sum("n").alias("n"), F.count("*").alias("n_types"))


def phoneme_tokenise(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = vocabulary(spark, sf_dir)
    found = F.regexp_extract_all("word", F.lit(TOKEN), F.lit(1))
    return words.select("word", "n", F.concat_ws(" ", found).alias("tokens"), (F.concat_ws("", found) == F.col("word")).alias("accepted"))


def phoneme_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distribution of every tier's symbols."""
    words = spoken(spark, sf_dir)
    tagged = F.array(*(F.struct(F.lit(name).alias("tier"), t(F.col("tokens")).alias("symbols")) for name, t in tiers.TIERS.items()))
    rows = words.select("n", F.explode(tagged).alias("t")).select("n", F.col("t.tier").alias("tier"), F.explode("t.symbols").alias("symbol"))
    counted = rows.groupBy("tier", "symbol").agg(F.sum("n").alias("n"))
    return counted.select("tier", "symbol", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("tier")), 6).alias("freq"))


def phoneme_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = cut(ngrams.ngram_counts(spoken(spark, sf_dir), F.col("tokens"), 2, F.col("n")))
    return ngrams.pmi(counts, 2).select(F.col("ctx")[0].alias("x"), F.col("sym").alias("y"), "n", F.round("pmi", 6).alias("pmi"))


def phoneme_pmi_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 30 strongest and the 30 weakest pairs of sounds."""
    counts = cut(ngrams.ngram_counts(spoken(spark, sf_dir), F.col("tokens"), 2, F.col("n")))
    return ngrams.pmi_extremes(counts).select("side", F.col("place").cast("long").alias("place"), F.col("ctx")[0].alias("x"), F.col("sym").alias("y"), "n", F.round("pmi", 6).alias("pmi"))


#: What vowels are compared by.
_VOWEL_FEATURES = {k: {p: "+" if PHONEMES[p].get(k) else "-" for p in VOWELS} for k in ("high", "low", "back", "round", "central")}


def vowel_feature_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the vowels on both sides of a consonant agree in a feature, against chance."""
    grams = ngrams.ngram_counts(spoken(spark, sf_dir), F.col("tokens"), 3, F.col("n"), edges=False).select(F.col("ctx")[0].alias("u"), F.col("ctx")[1].alias("c"), F.col("sym").alias("v"), "n")
    triples = cut(grams.filter(F.col("u").isin(*VOWELS) & F.col("v").isin(*VOWELS) & F.col("c").isin(*CONSONANTS)))
    return ngrams.feature_agreement(triples, _VOWEL_FEATURES).select("c", "feature", "n", F.round("agreement", 6).alias("agreement"), F.round("chance", 6).alias("chance"), "mark")


def top10_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each language the ten most frequent letters: their tokens among all words, and words of nothing else."""
    words = lexicon(spark, sf_dir)
    letters = words.select("lang", F.explode(F.split("word", "")).alias("symbol"), "n").groupBy("lang", "symbol").agg(F.sum("n").alias("n"))
    top = cut(letters.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "symbol"))).filter("place <= 10"))
    sets = top.groupBy("lang").agg(F.array_join(F.array_sort(F.collect_list("symbol")), "").alias("letters"), F.sum("n").alias("tokens"))
    whole = words.groupBy("lang").agg(F.sum("n").alias("words")).join(sets, "lang").select("lang", F.lit("truncate").alias("mode"), "letters", "words", "tokens")
    only = words.join(sets.drop("tokens"), "lang").filter(F.expr("translate(word, letters, '') = ''"))
    kept = only.groupBy("lang", "letters").agg(F.sum("n").alias("words"), F.sum(F.length("word") * F.col("n")).alias("tokens"))
    return whole.unionByName(kept.select("lang", F.lit("only").alias("mode"), "letters", "words", "tokens"))


def sequence_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where registered sequences of sounds stand in words: whole sounds, so that c is not found in tc."""
    asked = [("c", ["c"]), ("t", ["t"]), ("an", ["a", "n"]), ("tsa", ["ts", "a"])]
    forms = F.array(*(F.struct(F.lit(k).alias("form"), F.array(*map(F.lit, v)).alias("sounds")) for k, v in asked))
    rows = spoken(spark, sf_dir).select("word", "n", "tokens", F.explode(forms).alias("f")).select("word", "n", F.col("f.form").alias("form"), tiers.sequence_offsets(F.col("tokens"), F.col("f.sounds")).alias("at"))
    return rows.filter(F.size("at") > 0).select("word", "n", "form", F.array_join(F.transform("at", lambda i: i.cast("string")), ",").alias("offsets"))


def class_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = cut(ngrams.ngram_counts(spoken(spark, sf_dir), tiers.tier("natural_class")(F.col("tokens")), 2, F.col("n")))
    return ngrams.transition_matrix(counts).select(F.col("ctx")[0].alias("x"), F.col("sym").alias("y"), "n", F.round("p_smooth", 6).alias("p_smooth"), F.round("p_raw", 6).alias("p_raw"))


def vowel_harmony(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of vowels with one consonant between them: the share that is equal, against independence, by consonant."""
    grams = ngrams.ngram_counts(spoken(spark, sf_dir), F.col("tokens"), 3, F.col("n"), edges=False)
    vcv = grams.select(F.col("ctx")[0].alias("u"), F.col("ctx")[1].alias("c"), F.col("sym").alias("v"), "n").filter(F.col("u").isin(*VOWELS) & F.col("v").isin(*VOWELS) & F.col("c").isin(*CONSONANTS))
    by = Window.partitionBy("c")
    shares = vcv.withColumns({"t": F.sum("n").over(by), "nu": F.sum("n").over(Window.partitionBy("c", "u"))})
    left = shares.select("c", "u", "nu", "t").distinct().withColumnRenamed("u", "x")
    right = shares.select("c", "v", F.sum("n").over(Window.partitionBy("c", "v")).alias("nv")).distinct().withColumnRenamed("v", "x")
    chance = left.join(right, ["c", "x"]).groupBy("c").agg(F.sum(F.col("nu") * F.col("nv") / (F.col("t") * F.col("t").cast("double"))).alias("independent"))
    seen = vcv.groupBy("c").agg(F.sum("n").alias("n"), (F.sum(F.when(F.col("u") == F.col("v"), F.col("n")).otherwise(0)) / F.sum("n")).alias("equal"))
    return seen.join(chance, "c", "left").select("c", "n", F.round("equal", 6).alias("equal"), F.round(F.coalesce("independent", F.lit(0.0)), 6).alias("independent"))


def pattern_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of a few patterns over all words, in one scan."""
    asked = [("three consonants", "*[C][C][C]", 1.0), ("obstruent before vowel", "([S]|[T])[+syl]", 1.0), ("final plosive", "[T]#", 1.0), ("two vowels", "[V][V]", 1.0), ("nasal plosive", "*[N][T]", 1.0), ("a literal", "th", 1.0)]
    return constraints.totals(spoken(spark, sf_dir), "word", "n", asked).select("name", F.col("violations").alias("matches"), "words")


def constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = constraints.violations(encoded(F.col("word")))
    return spoken(spark, sf_dir).select("word", "n", *(c.alias(k.lower().replace("-", "_")) for k, c in counts.items()))


def harmony_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of finite harmony that violate a soft constraint, and how many words a hard one excludes, by harmony."""
    counts = constraints.violations(encoded(F.col("word")))
    rows = spoken(spark, sf_dir).select("n", constraints.harmony(counts).alias("h"))
    return rows.groupBy(F.when(F.col("h") == float("inf"), "excluded").otherwise(F.format_string("%.1f", "h")).alias("harmony")).agg(F.count("*").alias("n_types"), F.sum("n").alias("n"))


def harmony_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What words violate, the greatest contribution first: how many words of each such list."""
    counts = constraints.violations(encoded(F.col("word")))
    rows = spoken(spark, sf_dir).select("n", constraints.explained(counts).alias("e")).filter("size(e) > 0")
    text = F.array_join(F.transform("e", lambda x: F.format_string("%s:%d:%.1f", x["name"], x["violations"], x["contribution"])), " ")
    return rows.groupBy(text.alias("explained")).agg(F.count("*").alias("n_types"), F.sum("n").alias("n"))


def licensed_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes of each language's syllables, by onsets that begin two of its words or more."""
    words = lexicon(spark, sf_dir).filter(F.concat_ws("", F.regexp_extract_all("word", F.lit(TOKEN), F.lit(1))) == F.col("word"))
    rows = onsets.licensed(cut(words.select("lang", encoded(F.col("word")).alias("code"), "n")), "".join(CODE[p] for p in VOWELS))
    vowels, rest = (("".join(CODE[p] for p in of)) for of in (VOWELS, CONSONANTS))
    shapes = rows.select("lang", "n", F.explode(F.split(F.translate("divided", vowels + rest, "V" * len(vowels) + "C" * len(rest)), r"\.")).alias("shape"))
    return shapes.groupBy("lang", "shape").agg(F.sum("n").alias("n"))


def word_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each divided word with its syllables, their shapes and morae by both scales, and those that lengthen."""
    def listed(of) -> Column:
        return F.array_join(F.transform("s", of), ".")

    return _divided(spark, sf_dir).select("word", "n", listed(lambda x: marked.spelling(x)).alias("syllabified"), F.size("s").cast("long").alias("n_syllables"), listed(lambda x: prosody.shape(x)).alias("shape"),
        *(listed(lambda x: prosody.morae(x, k).cast("string")).alias(f"morae_{k}") for k in prosody.SCALES), F.size(F.filter("s", lambda x: prosody.needs_lengthening(x))).cast("long").alias("n_lengthened"))


def word_ipa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spoken(spark, sf_dir).select("word", "n", morphology.to_ipa(F.col("tokens")).alias("ipa"))


def syllable_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _spread(spoken(spark, sf_dir)).select("n", F.explode(syllables.syllables(F.col("word"))["syllables"]).alias("s"))
    return words.groupBy(prosody.shape(F.col("s")).alias("shape"), prosody.weight(prosody.morae(F.col("s"))).alias("rime_weight"), prosody.weight(prosody.morae(F.col("s"), "onset_sensitive")).alias("onset_weight")).agg(F.sum("n").alias("n"))


def _divided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word, n, s): the words that can be divided, with their syllables."""
    return _spread(spoken(spark, sf_dir)).select("word", "n", syllables.syllables(F.col("word"))["syllables"].alias("s")).filter("s is not null")


def syllable_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distribution of every syllable tier's symbols."""
    tagged = F.array(*(F.struct(F.lit(name).alias("tier"), t(F.col("s")).alias("symbols")) for name, t in tiers.SYLLABLE_TIERS.items()))
    rows = _divided(spark, sf_dir).select("n", F.explode(tagged).alias("t")).select("n", F.col("t.tier").alias("tier"), F.explode("t.symbols").alias("symbol"))
    counted = rows.groupBy("tier", "symbol").agg(F.sum("n").alias("n"))
    return counted.select("tier", "symbol", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("tier")), 6).alias("freq"))


#: (name, tier, pattern) of ``pattern_syllable_count``.
_MARKED = [
    ("coda before onset", "segment", "[C].[C]"), ("open before onset", "segment", "[V].[C]"), ("across syllables", "segment", "*[C][C][C]"), ("final coda", "segment", "[role=coda]#"),
    ("penult nucleus", "segment", "[+syl,role=nucleus,penult=true]"), ("second of an onset", "segment", "[role=onset,role_index>=1]"), ("superheavy", "syllable", "[weight=superheavy]"), ("two open at the end", "syllable", "[open=true]{2}#"),
    ("three syllables", "syllable", "σσσ"), ("from the third on", "syllable", "[index>=2]"),
]


def pattern_syllable_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of patterns over sounds and syllables of divided words, all in one scan."""
    rows = _divided(spark, sf_dir).select("n", *(f(F.col("s")).alias(k) for k, f in (("segment", marked.segments), ("syllable", marked.syllable_tier))))
    hits = rows.select("n", *(marked.compile_marked(p, t).count(F.col(t)).alias(f"v{i}") for i, (_, t, p) in enumerate(_MARKED)))
    summed = hits.agg(*(F.sum(F.col(f"v{i}") * F.col("n")).alias(f"m{i}") for i in range(len(_MARKED))), *(F.sum(F.when(F.col(f"v{i}") > 0, F.col("n")).otherwise(0)).alias(f"w{i}") for i in range(len(_MARKED))))
    return summed.select(F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.col(f"m{i}").alias("matches"), F.col(f"w{i}").alias("words")) for i, (name, _, _) in enumerate(_MARKED)))).alias("r")).select("r.*")


def rewrite_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    derived = _spread(spoken(spark, sf_dir)).select("word", rewriting.rewritten(F.col("word"))["result"].alias("result"))
    return rewriting.collisions(derived)


def join_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark word with the next one of its item, joined by vowels and by consonants."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(words_of(F.col("text"))).alias("pos", "word"))
    pairs = rows.withColumn("next", F.lead("word").over(Window.partitionBy("item_id").orderBy("pos"))).filter("next is not null").select("word", "next").distinct()
    return pairs.select("word", "next", morphology.vowel_join(F.col("word"), F.col("next")).alias("by_vowels"), morphology.consonant_join(F.col("word"), F.col("next")).alias("by_consonants"))


def word_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.audit(_spread(lexicon(spark, sf_dir)))


def affix_seams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What joining the four endings does to the words of the benchmark."""
    stems = table(spark, sf_dir, "benchmark").select(F.explode(words_of(F.col("text"))).alias("word")).distinct()
    endings = spark.createDataFrame([("os",), ("tos",), ("in",), ("ka",)], "affix string")
    return reports.affix_report(stems, endings)


def candidate_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's words as candidates for the lexicon of the documents."""
    asked = table(spark, sf_dir, "benchmark").select(F.explode(words_of(F.col("text"))).alias("word"))
    return reports.candidate_report(asked, lexicon(spark, sf_dir)).withColumn("notes", F.array_join("notes", ","))


def default_falls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the default rule puts the accent, by number of syllables and weight scale."""
    rows = _spread(spoken(spark, sf_dir)).select("n", syllables.syllables(F.col("word"))["syllables"].alias("s")).filter("s is not null")
    scales = F.array(*(F.struct(F.lit(k).alias("scale"), reports.default_fall(F.col("s"), k).alias("fall")) for k in prosody.SCALES))
    return rows.select("n", F.size("s").cast("long").alias("syllables"), F.explode(scales).alias("d")).groupBy("d.scale", "syllables", F.col("d.fall").cast("long").alias("fall")).agg(F.sum("n").alias("n"))


def stimulus_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two words for each combination of first-syllable shapes."""
    return reports.stimulus_design({"onset": ["0", "1", "2"], "nucleus": ["1", "2"], "coda": ["0", "1", "2"]}, spoken(spark, sf_dir))


def maxent_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = cut(spoken(spark, sf_dir))
    asked = [("ccc", "*[C][C][C]", 1.0), ("final_t", "*[T]#", 1.0), ("vv", "*[V][V]", 1.0), CONSTRAINTS[2]]
    return constraints.maxent(words, "word", "n", baselines.sample(baselines.fit(words, "tokens", "n"), 4000), "word", asked)


def constraint_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of classes at three places, against random words of the same skeletons."""
    words = cut(spoken(spark, sf_dir))
    return constraints.evaluated(words, "word", "n", baselines.sample(baselines.fit(words, "tokens", "n"), 4000), "word", constraints.candidates())


def constraint_evaluation_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same against divisible random words of each model, on top of the declared constraints."""
    words = cut(spoken(spark, sf_dir))
    found, seen = None, constraints.count_histograms(words, "word", "n", constraints.candidates(), CONSTRAINTS)
    for mode in baselines.MODES:
        samples = baselines.sample(baselines.fit(words, "tokens", "n", mode), 4000, accept="divided")
        rows = constraints.evaluated(words, "word", "n", samples, "word", constraints.candidates(), grammar=CONSTRAINTS, seen=seen).withColumn("mode", F.lit(mode))
        found = rows if found is None else found.unionByName(rows)
    return found


def baseline_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """300 random words of legal syllables by each model of the spoken words."""
    words = cut(spoken(spark, sf_dir))
    found = [baselines.sample(baselines.fit(words, "tokens", "n", mode), 300, 1, "legal").select(F.lit(mode).alias("mode"), "try", "word") for mode in baselines.MODES]
    return found[0].unionByName(found[1]).unionByName(found[2])


def baseline_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of 1000 tries of each model: how many can be divided, have legal parts, and are words of the lexicon."""
    words = cut(spoken(spark, sf_dir))
    out = None
    for mode in baselines.MODES:
        tries = cut(baselines.spelled(baselines.fit(words, "tokens", "n", mode), 0, 1000, 2))
        known = tries.join(words.select("word"), "word", "left_semi").select(F.lit("known").alias("test"))
        tests = [baselines.accepted(tries, a).select(F.lit(a).alias("test")) for a in baselines.ACCEPT]
        rows = known.unionByName(tests[0]).unionByName(tests[1]).unionByName(tests[2]).groupBy("test").agg(F.count("*").alias("words")).withColumn("mode", F.lit(mode))
        out = rows if out is None else out.unionByName(rows)
    return out


def rank_laws_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = lexicon(spark, sf_dir).select("lang", F.explode(F.split("word", "")).alias("symbol"), "n").groupBy("lang", "symbol").agg(F.sum("n").alias("n"))
    return distributions.rank_laws(letters, "lang")


def page_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comment markers of pages whose next element isn't a div, and those whose is, by element."""
    html = F.coalesce(F.col("html"), F.lit(""))
    tags = F.regexp_extract_all(html, F.lit(r"<(!--|[a-zA-Z][a-zA-Z0-9]*)"), F.lit(1))
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(tags).alias("pos", "tag"))
    marked = rows.select("tag", F.lead("tag").over(Window.partitionBy("page_id").orderBy("pos")).alias("next")).filter("tag = '!--'")
    return marked.groupBy(F.coalesce("next", F.lit("(end)")).alias("next")).agg(F.count("*").alias("n"))


def divisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every division of the benchmark's words into syllables, in order."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(words_of(F.col("text"))).alias("word")).distinct()
    return words.lateralJoin(syllables.Divisions(F.col("word").outer())).select("word", F.col("place").cast("long").alias("place"), "divided", "legal")


def best_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The division of each word that fills onsets, and the one that fills codas."""
    def text(score: syllables.Score) -> Column:
        return F.array_join(F.transform(syllables.syllables(F.col("word"), score)["syllables"], lambda x: marked.spelling(x)), ".")

    return _spread(spoken(spark, sf_dir)).select("word", text(syllables.onsets_first).alias("by_onset"), text(syllables.codas_first).alias("by_coda")).filter("by_onset is not null")


def correction_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands for what when words are aligned with their corrections, letter by letter, over all words."""
    def letters(c: str) -> Column:
        return F.when(F.length(c) > 0, F.split(c, "")).otherwise(F.array().cast("array<string>"))

    rows = _spread(spoken(spark, sf_dir)).select("n", letters("word").alias("x"), rewriting.rewritten(F.col("word"))["result"].alias("y")).withColumn("y", letters("y")).filter("x <> y")
    pairs = rows.select("n", F.explode(alignment.aligned_pairs(F.col("x"), F.col("y"), alignment.alignment(F.col("x"), F.col("y"))["steps"])).alias("p")).select("n", "p.*")
    return pairs.filter("not (left <=> right)").groupBy(F.coalesce("left", F.lit("")).alias("left"), F.coalesce("right", F.lit("")).alias("right"), "copy").agg(F.sum("n").alias("n"))


def accent_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and scales against the accents of transcriptions, in which short vowels are doubled.

    The accents are those of the default rule by the onset-sensitive scale: F in words of an even number of letters, H
    before L in the others.
    """
    s, n = F.col("s"), F.size("s")
    at = F.sequence(F.lit(0), n - 1)

    def spelled(i: Column) -> Column:
        """A syllable, its vowel doubled where it lengthens and the next one doesn't begin with the same letter."""
        x, vowel = F.get(s, i), F.element_at(F.get(s, i)["nucleus"], -1)
        doubled = prosody.needs_lengthening(x) & ~F.coalesce(F.substring(marked.spelling(F.get(s, i + 1)), 1, 1) == vowel, F.lit(False))
        return F.concat(F.array_join(x["onset"], ""), F.array_join(x["nucleus"], ""), F.when(doubled, vowel).otherwise(""), F.array_join(x["coda"], ""))

    p = reports.default_fall(s, "onset_sensitive")
    falling = F.concat(F.repeat(F.lit("L"), p), F.lit("F"), F.repeat(F.lit("L"), n - p - 1))
    dropping = F.when(p < n - 1, F.concat(F.repeat(F.lit("L"), p), F.lit("HL"), F.repeat(F.lit("L"), n - p - 2))).otherwise(F.repeat(F.lit("L"), n))
    rows = cut(_divided(spark, sf_dir)).select("word", "n", F.array_join(F.transform(at, spelled), ".").alias("transcription"), F.when(F.length("word") % 2 == 0, falling).otherwise(dropping).alias("accent"))
    return reports.accent_rules(rows, F.col("n")).withColumn("share", F.round("share", 6))


#: Known words and their places in ``blind_stimuli``.
_ANCHORS = (("kata", 1), ("pata", 25), ("kalam", 50))


def blind_stimuli(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All spoken words in a blind order, a tenth of them twice, at least 20 places apart."""
    return blind.blind_order(spoken(spark, sf_dir), seed=5, anchors=_ANCHORS)


def colour_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the colour model's letters: under how many backgrounds they are well formed, how far their colours move, their
    repeats and dispersion, and their forms in harmony with the first half of their vowels, or with the rest."""
    word = F.col("word")
    words = vocabulary(spark, sf_dir).filter(colours.in_set(word))
    isles = cut(_spread(words).select("word", "n", colours.islands(word, 0).alias("i0"), colours.islands(word, 1).alias("i1")))
    of = [F.col("i0"), F.col("i1")]
    half = F.floor((F.size(colours.vowels(word)) + 1) / 2)
    return isles.select(
        "word", "n", F.size(colours.good_backgrounds(of)).cast("long").alias("n_good"), F.round(colours.transport(of, (0.5, 0.0)), 6).alias("transport"), colours.repeats(word).cast("long").alias("repeats"),
        F.round(colours.dispersion(word), 6).alias("dispersion"), colours.harmony(word, half).alias("by_root"), colours.harmony(word, half, True).alias("by_suffix"),
    )


QUERIES = {f.__name__: f for f in (
    word_rank_stats, lang_js_divergence, lang_summary_ratios, cv_clusters, cv_counts, phoneme_tokenise, phoneme_distribution, phoneme_bigrams, phoneme_pmi_extremes, vowel_feature_agreement, top10_variants, sequence_hits, class_bigrams, vowel_harmony, pattern_count,
    constraint_violations, harmony_rank, harmony_explained, licensed_shapes, word_projection, word_ipa, syllable_shapes, syllable_tiers, pattern_syllable_count, rewrite_corrections, join_forms, word_audit, affix_seams, candidate_words, default_falls, stimulus_cells, maxent_weights, constraint_evaluation, constraint_evaluation_models, baseline_samples, baseline_acceptance, divisions, best_by, correction_pairs, accent_rules, blind_stimuli, colour_report, rank_laws_letters, page_markers,
)}

_LEX = "lex AS (SELECT lang, w AS word, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents) GROUP BY lang, w)"
_ALPHABET = "".join(p for p in PHONEMES if len(p) == 1)
_TOKENS = f"regexp_extract_all(word, '{'|'.join(DIGRAPHS)}|[{_ALPHABET}]')"
_SPOKEN = f"{_LEX}, counted AS (SELECT word, sum(n) AS n FROM lex GROUP BY word), spoken AS (SELECT word, CAST(n AS BIGINT) AS n, {_TOKENS} AS tokens FROM counted WHERE array_to_string({_TOKENS}, '') = word)"


def _code(word: str) -> str:
    for p in DIGRAPHS:
        word = f"replace({word}, '{p}', '{CODE[p]}')"
    return word


def _case(column: str, values: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


def _set(members) -> str:
    return "".join(CODE[p] for p in members)


def _starts(pattern: str) -> str:
    """Places where a pattern begins: RE2 has no lookahead, so each suffix is matched at its start."""
    return f"CAST(len(list_filter(range(1, length(code) + 2), lambda i: regexp_matches(substr(code, i), '^(?:{patterns.compile_pattern(pattern).java})'))) AS BIGINT)"


_JS = """
js AS (SELECT unit, l.lang AS left_lang, r.lang AS right_lang, sum(CASE WHEN p > 0 THEN 0.5 * p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN 0.5 * q * log2(q / ((p + q) / 2)) ELSE 0 END) AS js
  FROM (SELECT s.unit, s.symbol, l.lang AS ll, r.lang AS rl, coalesce(x.f, 0) AS p, coalesce(y.f, 0) AS q FROM (SELECT DISTINCT unit, symbol FROM f) s CROSS JOIN (SELECT DISTINCT lang FROM f) l CROSS JOIN (SELECT DISTINCT lang FROM f) r
    LEFT JOIN f x ON x.unit = s.unit AND x.symbol = s.symbol AND x.lang = l.lang LEFT JOIN f y ON y.unit = s.unit AND y.symbol = s.symbol AND y.lang = r.lang WHERE l.lang < r.lang) t
  JOIN (SELECT DISTINCT lang FROM f) l ON l.lang = t.ll JOIN (SELECT DISTINCT lang FROM f) r ON r.lang = t.rl GROUP BY 1, 2, 3)
"""
_PATTERNS = [("three consonants", "*[C][C][C]"), ("obstruent before vowel", "([S]|[T])[+syl]"), ("final plosive", "[T]#"), ("two vowels", "[V][V]"), ("nasal plosive", "*[N][T]"), ("a literal", "th")]
_TIER_SQL = {
    "phoneme": {p: p for p in PHONEMES}, "ipa": {p: f["ipa"] for p, f in PHONEMES.items()}, "natural_class": CLASS_OF, "cv": {p: "V" if f["syl"] else "C" for p, f in PHONEMES.items()},
    "manner": {p: f["manner"] for p, f in PHONEMES.items()}, "place": {p: f["place"] for p, f in PHONEMES.items()}, "sonority": {p: f["sonor"] for p, f in PHONEMES.items()},
}
_GRAMS = "padded AS (SELECT n, list_concat(['<s>'], list_concat({0}, ['</s>'])) AS s FROM spoken), counts AS (SELECT s[i] AS x, s[i + 1] AS y, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, s, unnest(range(1, len(s))) AS i FROM padded) GROUP BY 1, 2)"
_HARM = f"""WITH {_SPOKEN}, g AS (SELECT tokens[i] AS u, tokens[i + 1] AS c, tokens[i + 2] AS v, n FROM (SELECT tokens, n, unnest(range(1, len(tokens) - 1)) AS i FROM spoken)),
vcv AS (SELECT u, c, v, sum(n) AS n FROM g WHERE u IN {VOWELS} AND v IN {VOWELS} AND c IN {CONSONANTS} GROUP BY 1, 2, 3),
a AS (SELECT c, u AS x, sum(n) AS nu FROM vcv GROUP BY 1, 2), b AS (SELECT c, v AS x, sum(n) AS nv FROM vcv GROUP BY 1, 2), t AS (SELECT c, sum(n) AS t, sum(CASE WHEN u = v THEN n ELSE 0 END) AS e FROM vcv GROUP BY c),
ind AS (SELECT c, sum(CAST(nu AS DOUBLE) * nv / (CAST(t AS DOUBLE) * t)) AS i FROM a JOIN b USING (c, x) JOIN t USING (c) GROUP BY c)
SELECT c, CAST(t AS BIGINT) AS n, round(e / CAST(t AS DOUBLE), 6) AS equal, round(coalesce(i, 0), 6) AS independent FROM t LEFT JOIN ind USING (c)"""

_FUSED = {pair: chr(0xE000 + i) for i, pair in enumerate(FUSION)}  # one character for each pair that has fused
_PLOSIVES, _NASALS = _set(MEMBERS["T"]), _set(MEMBERS["N"])
_FUSE = "list_reduce(list_prepend('', string_split(code, '')), lambda a, x: CASE " + " ".join(f"WHEN right(a, 1) || x = '{k}' THEN left(a, length(a) - 1) || '{v}'" for k, v in _FUSED.items()) + " ELSE a || x END)"


def _sounds(code: str) -> str:
    for c, sound in [*((CODE[p], f["ipa"]) for p, f in PHONEMES.items() if p in DIGRAPHS), *((v, FUSION[k]) for k, v in _FUSED.items())]:
        code = f"replace({code}, '{c}', '{sound}')"
    return code


_PLAIN_IPA = {p: f["ipa"] for p, f in PHONEMES.items() if p not in DIGRAPHS and f["ipa"] != p}
_IPA = f"""WITH {_SPOKEN}, e AS (SELECT word, n, {_code('word')} AS code FROM spoken),
p AS (SELECT word, n, CASE WHEN regexp_matches(code, '(^|[^{_set(CONSONANTS)}])[{_PLOSIVES}]$') THEN left(code, length(code) - 1) WHEN regexp_matches(code, '[{_NASALS}][{_PLOSIVES}]$') THEN left(code, length(code) - 2) ELSE code END AS code,
  CASE WHEN regexp_matches(code, '(^|[^{_set(CONSONANTS)}]|[{_NASALS}])[{_PLOSIVES}]$') THEN 'ʔ' ELSE '' END AS stop FROM e),
f AS (SELECT word, n, stop, coalesce({_FUSE}, '') AS code FROM p)
SELECT word, n, {_sounds(f"translate(code, '{''.join(_PLAIN_IPA)}', '{''.join(_PLAIN_IPA.values())}')")} || stop AS ipa FROM f"""
_VCV = f"g AS (SELECT tokens[i] AS u, tokens[i + 1] AS c, tokens[i + 2] AS v, n FROM (SELECT tokens, n, unnest(range(1, len(tokens) - 1)) AS i FROM spoken)), vcv AS (SELECT u, c, v, sum(n) AS n FROM g WHERE u IN {VOWELS} AND v IN {VOWELS} AND c IN {CONSONANTS} GROUP BY 1, 2, 3)"
_FEATURE_ROWS = "feats(feature, x, value) AS (VALUES " + ", ".join(f"('{k}', '{x}', '{v}')" for k, of in _VOWEL_FEATURES.items() for x, v in of.items()) + ")"

_C, _V = _set(CONSONANTS), _set(VOWELS)


def _pairs(allowed: dict[str, str], classes: bool) -> list[str]:
    """Every legal part of two sounds, encoded."""
    return [CODE[a] + CODE[b] for a in PHONEMES for b in PHONEMES if (CLASS_OF[b] in allowed.get(CLASS_OF[a], "") if classes else b in allowed.get(a, ""))]


_PARTS = {"o": ("onset", _pairs(ONSET_PAIRS, True)), "v": ("nucleus", _pairs(NUCLEUS_PAIRS, False)), "c": ("coda", _pairs(CODA_PAIRS, True))}


def _legal(part: str, kind: str) -> str:
    return f"(length({part}) < 2 OR {part} IN ({', '.join(repr(p) for p in _PARTS[kind][1])}))"


def _ways(name: str, source: str, strict: bool) -> str:
    """Every division of the encoded words of ``source`` into onset, nucleus and coda of at most two sounds, and the best of each word."""
    legal = [_legal(part, part) for part in _PARTS]
    tests = " AND ".join([f"regexp_full_match(o, '[{_C}]*') AND regexp_full_match(v, '[{_V}]+') AND regexp_full_match(c, '[{_C}]*')", *(legal if strict else [])])
    return f"""{name}_cut AS (SELECT word, n, code, 1 AS pos, 0 AS total, [] :: INT[] AS onsets, [] :: INT[] AS sizes, [] :: STRUCT(o VARCHAR, v VARCHAR, c VARCHAR)[] AS s FROM {source}
  UNION ALL SELECT word, n, code, pos + length(o) + length(v) + length(c), total + length(o), list_append(onsets, length(o)), list_append(sizes, length(v) * 10 + length(c)), list_append(s, {{'o': o, 'v': v, 'c': c}}) FROM
    (SELECT d.*, substr(code, pos, a) AS o, substr(code, pos + a, b) AS v, substr(code, pos + a + b, e) AS c FROM {name}_cut d, sizes_of WHERE pos + a + b + e <= length(code) + 1) WHERE {tests}),
{name} AS (SELECT word, n, code, s FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY total DESC, len(onsets), onsets DESC, sizes) AS r FROM {name}_cut WHERE pos > length(code)) WHERE r = 1)"""


_SIZES = "sizes_of AS (SELECT a, b, e FROM (VALUES (0), (1), (2)) x(a), (VALUES (1), (2)) y(b), (VALUES (0), (1), (2)) z(e))"


def _divided_sql(sources: str) -> str:
    """``divided``: the words of ``spoken``, which ``sources`` defines, with their syllables; ``whole`` where all parts are legal."""
    return f"""WITH RECURSIVE {sources}, {_SIZES}, enc AS (SELECT word, n, {_code('word')} AS code FROM spoken),
{_ways('strict', 'enc', True)}, rest AS (SELECT * FROM enc WHERE word NOT IN (SELECT word FROM strict)), {_ways('relaxed', 'rest', False)},
divided AS (SELECT *, true AS whole FROM strict UNION ALL SELECT *, false FROM relaxed)"""


_DIVIDED = _divided_sql(_SPOKEN)


def _baseline_sql(seed: int, tries: int) -> str:
    """``tried`` (mode, try, word): random words of the three models by the hashes of their tries."""
    u = "CAST('0x' || substr(md5('{0}:' || {1}), 1, 12) AS BIGINT)"
    return f"""{_SPOKEN},
places AS (SELECT tokens[i] AS symbol, i, len(tokens) AS size, n FROM (SELECT tokens, n, unnest(range(1, len(tokens) + 1)) AS i FROM spoken)),
placed AS (
  SELECT 'cv' AS mode, CASE WHEN symbol IN {VOWELS} THEN 'V' ELSE 'C' END AS place, symbol, n FROM places UNION ALL SELECT 'unigram', 'all', symbol, n FROM places
  UNION ALL SELECT 'positional', CASE WHEN i = 1 THEN 'first' WHEN i = size THEN 'last' ELSE 'middle' END, symbol, n FROM places),
sounds AS (SELECT mode, place, symbol, w, sum(w) OVER (PARTITION BY mode, place ORDER BY symbol) AS high, sum(w) OVER (PARTITION BY mode, place) AS total FROM (SELECT mode, place, symbol, sum(n) AS w FROM placed GROUP BY ALL)),
wholes AS (
  SELECT 'cv' AS mode, array_to_string(list_transform(tokens, lambda p: CASE WHEN p IN {VOWELS} THEN 'V' ELSE 'C' END), '') AS symbol, n FROM spoken
  UNION ALL SELECT m, CAST(len(tokens) AS VARCHAR), n FROM spoken, (VALUES ('unigram'), ('positional')) v(m)),
ranges AS (SELECT mode, symbol, w, sum(w) OVER (PARTITION BY mode ORDER BY md5(symbol), symbol) AS high, sum(w) OVER (PARTITION BY mode) AS total FROM (SELECT mode, symbol, sum(n) AS w FROM wholes GROUP BY ALL)),
drawn AS (SELECT mode, t, symbol FROM ranges, (SELECT unnest(range(0, {tries})) AS t) WHERE {u.format(seed, "t || ':w'")} % total >= high - w AND {u.format(seed, "t || ':w'")} % total < high),
spots AS (SELECT mode, t, symbol, unnest(range(0, size)) AS i, size FROM (SELECT *, CASE WHEN mode = 'cv' THEN length(symbol) ELSE CAST(symbol AS INT) END AS size FROM (SELECT * FROM drawn))),
kinds AS (SELECT mode, t, i, CASE WHEN mode = 'cv' THEN symbol[i + 1] WHEN mode = 'unigram' THEN 'all' WHEN i = 0 THEN 'first' WHEN i = size - 1 THEN 'last' ELSE 'middle' END AS place FROM spots),
tried AS (SELECT k.mode, t AS try, string_agg(symbol, '' ORDER BY i) AS word FROM kinds k JOIN sounds s ON s.mode = k.mode AND s.place = k.place AND {u.format(seed, "t || ':' || i")} % total >= high - w AND {u.format(seed, "t || ':' || i")} % total < high GROUP BY k.mode, t)"""


def _accepted_sql(seed: int, tries: int) -> str:
    return f"""WITH RECURSIVE {_baseline_sql(seed, tries)}, {_SIZES}, enc AS (SELECT word, 1 AS n, {_code('word')} AS code FROM (SELECT DISTINCT word FROM tried)),
{_ways('strict', 'enc', True)}, rest AS (SELECT * FROM enc WHERE word NOT IN (SELECT word FROM strict)), {_ways('relaxed', 'rest', False)}"""


_BASELINES = {
    "baseline_samples": f"{_accepted_sql(1, 2500)} SELECT mode, try, word FROM tried WHERE word IN (SELECT word FROM strict) QUALIFY row_number() OVER (PARTITION BY mode ORDER BY try) <= 300",
    "baseline_acceptance": f"""{_accepted_sql(2, 1000)} SELECT mode, test, count(*) AS words FROM (
  SELECT mode, 'any' AS test FROM tried UNION ALL SELECT mode, 'legal' FROM tried WHERE word IN (SELECT word FROM strict) UNION ALL SELECT mode, 'known' FROM tried WHERE word IN (SELECT word FROM spoken)
  UNION ALL SELECT mode, 'divided' FROM tried WHERE word IN (SELECT word FROM strict) OR word IN (SELECT word FROM relaxed)) GROUP BY mode, test""",
}


def _morae(s: str, scale: str = "rime") -> str:
    return f"(CASE WHEN length({s}.v) > 1 THEN 2 ELSE 1 END + length({s}.c) + greatest(length({s}.o) - 1, 0) * {prosody.SCALES[scale]['onset']})"


def _weight(s: str, scale: str = "rime") -> str:
    return f"CASE WHEN {_morae(s, scale)} <= 1 THEN 'light' WHEN {_morae(s, scale)} = 2 THEN 'heavy' ELSE 'superheavy' END"


def _spelled(code: str) -> str:
    for p in DIGRAPHS:
        code = f"replace({code}, '{CODE[p]}', '{p}')"
    return code


def _class_of(code: str) -> str:
    return f"translate({code}, '{''.join(CODE[p] for p in CLASS_OF)}', '{''.join(CLASS_OF.values())}')"


_SHAPE = "repeat('C', length(x.o)) || repeat('V', length(x.v)) || repeat('C', length(x.c))"
_SYLLABLE_SQL = {
    "syllable": _spelled("x.o || x.v || x.c"), "syllable_shape": _SHAPE, "syllable_class_shape": f"{_class_of('x.o')} || '-' || {_class_of('x.v')} || '-' || {_class_of('x.c')}",
    "onset_shape": f"CASE WHEN x.o = '' THEN '∅' ELSE {_class_of('x.o')} END", "coda_shape": f"CASE WHEN x.c = '' THEN '∅' ELSE {_class_of('x.c')} END",
    **{f"weight:{k}": _weight("x", k) for k in prosody.SCALES}, **{f"mora:{k}": f"CAST({_morae('x', k)} AS VARCHAR)" for k in prosody.SCALES},
}


def _dotted(pattern: str) -> str:
    """Places of a word, marked by # and ., where an expression begins."""
    return f"len(list_filter(range(1, length(dotted) + 1), lambda i: regexp_matches(substr(dotted, i), '^(?:{pattern})')))"


_MARKED_SQL = [
    _dotted(rf"[{_C}]\.[{_C}]"), _dotted(rf"[{_V}]\.[{_C}]"), _dotted(rf"[{_C}]\.?[{_C}]\.?[{_C}]"), "CASE WHEN s[-1].c <> '' THEN 1 ELSE 0 END", "CASE WHEN len(s) > 1 THEN length(s[-2].v) ELSE 0 END",
    "len(list_filter(s, lambda x: length(x.o) > 1))", f"len(list_filter(s, lambda x: {_morae('x')} > 2))", "CASE WHEN len(s) > 1 AND s[-1].c = '' AND s[-2].c = '' THEN 1 ELSE 0 END", "greatest(len(s) - 2, 0)", "greatest(len(s) - 2, 0)",
]


def _fall(scale: str) -> str:
    heavy = f"list_filter(range(0, len(s) - 1), lambda i: {_morae('s[i + 1]', scale)} > 1)"
    return f"CASE WHEN len(s) = 1 THEN 0 ELSE coalesce({heavy}[1], len(s) - 2) END"


def _respelled(word: str) -> str:
    """A word by the spelling rules, set after set."""
    for rules in SPELLING:
        code = _code(word)
        for taken, given in rules.items():
            a, b, dropped = ("".join(CODE[p] for p in split(x)) for x in (taken, given, taken.removesuffix(given)))
            pattern = a if not taken.endswith(given) else f"(?:{dropped})+{b}"
            code = f"regexp_replace({code}, '{pattern}', '{b}', 'g')"
        word = _spelled(code)
    return word


_ASKED = f"asked AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark), spoken AS (SELECT word, 1 AS n FROM asked WHERE array_to_string({_TOKENS}, '') = word)"
_NOTES = "flatten(list_transform(s, lambda x: list_filter([" + ", ".join(f"CASE WHEN {_legal('x.' + k, k)} THEN '' ELSE '{name} ' || {_spelled('x.' + k)} END" for k, (name, _) in _PARTS.items()) + "], lambda y: y <> '')))"
_DELETED = "SELECT DISTINCT {0} AS {1}, k FROM (SELECT {0}, unnest(list_append(list_transform(range(1, length({0}) + 1), lambda i: substr({0}, 1, i - 1) || substr({0}, i + 1)), {0})) AS k FROM {2})"
_CANDIDATES = f"""{_divided_sql(f"{_LEX}, {_ASKED}")}, known AS (SELECT DISTINCT word FROM lex), da AS ({_DELETED.format('word', 'x', 'asked')}), db AS ({_DELETED.format('word', 'y', 'known')}),
near AS (SELECT x AS word, count(*) AS neighbours, min(y) AS nearest FROM (SELECT DISTINCT x, y FROM da JOIN db USING (k) WHERE x <> y AND levenshtein(x, y) <= 1) GROUP BY x)
SELECT word, p.word IS NOT NULL AS spellable, coalesce(d.whole, false) AS strict, CASE WHEN d.s IS NULL OR d.whole THEN '' ELSE array_to_string({_NOTES}, ',') END AS notes, length(regexp_extract({_code('word')}, '[{_C}]{{4}}')) > 0 AS long_run,
  CASE WHEN p.word IS NOT NULL THEN {_respelled('word')} END AS spelled, coalesce(neighbours, 0) AS neighbours, nearest, k.word IS NOT NULL AS registered
FROM asked LEFT JOIN spoken p USING (word) LEFT JOIN divided d USING (word) LEFT JOIN near USING (word) LEFT JOIN known k USING (word)"""


def _listed(of: str) -> str:
    return f"array_to_string(list_transform(s, lambda x: {of}), '.')"


_LICENSED = f"""WITH {_LEX}, w AS (SELECT lang, n, {_code('word')} AS code FROM lex WHERE array_to_string({_TOKENS}, '') = word),
lic AS (SELECT lang, onset FROM (SELECT lang, regexp_extract(code, '^([{_C}]+)[{_V}]', 1) AS onset FROM w) WHERE onset <> '' GROUP BY 1, 2 HAVING count(*) >= 2),
p AS (SELECT lang, code, n, regexp_extract(code, '^[{_C}]*') AS lead, regexp_extract_all(code, '[{_V}][{_C}]*') AS pieces FROM w),
q AS (SELECT lang, code, n, lead, len(pieces) AS k, unnest(pieces) AS piece, unnest(range(1, len(pieces) + 1)) AS i FROM p),
c AS (SELECT DISTINCT lang, substr(piece, 2) AS cluster FROM q WHERE i < k), b AS (SELECT c.lang, cluster, max(length(onset)) AS keep FROM c JOIN lic ON lic.lang = c.lang AND ends_with(cluster, onset) GROUP BY 1, 2),
d AS (SELECT q.lang, code, any_value(n) AS n, any_value(lead) || string_agg(CASE WHEN i = k THEN piece ELSE left(piece, length(piece) - coalesce(keep, 0)) || '.' || right(piece, coalesce(keep, 0)) END, '' ORDER BY i) AS divided FROM q LEFT JOIN b ON b.lang = q.lang AND b.cluster = substr(piece, 2) AND i < k GROUP BY 1, 2
  UNION ALL SELECT lang, code, n, code FROM p WHERE len(pieces) = 0),
s AS (SELECT lang, n, unnest(string_split(translate(divided, '{_V}{_C}', '{'V' * len(_V)}{'C' * len(_C)}'), '.')) AS shape FROM d) SELECT lang, shape, CAST(sum(n) AS BIGINT) AS n FROM s GROUP BY 1, 2"""
_EXPLAINED = f"""WITH {_SPOKEN}, e AS (SELECT n, {_code('word')} AS code FROM spoken), v AS (SELECT n, """ + ", ".join(f"{_starts(p)} AS v{i}" for i, (_, p, _) in enumerate(CONSTRAINTS)) + f""" FROM e)
SELECT concat_ws(' ', {', '.join(f"CASE WHEN v{i} > 0 THEN '{k}:' || v{i} || ':{'Infinity' if w == float('inf') else ''}'" + ("" if w == float("inf") else f" || printf('%.1f', v{i} * {w}::DOUBLE)") + " END" for i, (k, _, w) in enumerate(CONSTRAINTS))}) AS explained, count(*) AS n_types, CAST(sum(n) AS BIGINT) AS n FROM v WHERE {' + '.join(f'v{i}' for i in range(len(CONSTRAINTS)))} > 0 GROUP BY 1"""

ORACLES = {
    "harmony_explained": _EXPLAINED,
    "licensed_shapes": _LICENSED,
    "word_projection": f"""{_DIVIDED} SELECT word, CAST(n AS BIGINT) AS n, {_listed(_spelled('x.o || x.v || x.c'))} AS syllabified, len(s) AS n_syllables, {_listed(_SHAPE)} AS shape, {', '.join(f"{_listed(f'CAST({_morae("x", k)} AS VARCHAR)')} AS morae_{k}" for k in prosody.SCALES)},
      len(list_filter(s, lambda x: length(x.v) < 2 AND NOT regexp_matches(x.c, '^[{_set(MEMBERS["R"])}]'))) AS n_lengthened FROM divided""",
    "candidate_words": _CANDIDATES,
    "syllable_shapes": f"{_DIVIDED}, x AS (SELECT n, unnest(s) AS x FROM divided) SELECT {_SHAPE} AS shape, {_weight('x')} AS rime_weight, {_weight('x', 'onset_sensitive')} AS onset_weight, CAST(sum(n) AS BIGINT) AS n FROM x GROUP BY 1, 2, 3",
    "syllable_tiers": f"{_DIVIDED}, x AS (SELECT n, unnest(s) AS x FROM divided), c AS (SELECT tier, symbol, CAST(sum(n) AS BIGINT) AS n FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS tier, {q} AS symbol, n FROM x" for k, q in _SYLLABLE_SQL.items()) + ") GROUP BY 1, 2) SELECT tier, symbol, n, round(n / CAST(sum(n) OVER (PARTITION BY tier) AS DOUBLE), 6) AS freq FROM c",
    "pattern_syllable_count": f"{_DIVIDED}, d AS (SELECT n, s, '#' || array_to_string(list_transform(s, lambda x: x.o || x.v || x.c), '.') || '#' AS dotted FROM divided), v AS (SELECT n, " + ", ".join(f"{q} AS v{i}" for i, q in enumerate(_MARKED_SQL)) + " FROM d) " + " UNION ALL ".join(f"SELECT '{k}' AS name, CAST(sum(v{i} * n) AS BIGINT) AS matches, CAST(sum(CASE WHEN v{i} > 0 THEN n ELSE 0 END) AS BIGINT) AS words FROM v" for i, (k, _, _) in enumerate(_MARKED)),
    "default_falls": f"{_DIVIDED} " + " UNION ALL ".join(f"SELECT '{k}' AS scale, len(s) AS syllables, {_fall(k)} AS fall, CAST(sum(n) AS BIGINT) AS n FROM divided GROUP BY 2, 3" for k in prosody.SCALES),
    "word_audit": f"""{_DIVIDED}, all_words AS (SELECT DISTINCT word FROM lex), j AS (SELECT a.word, spoken.word IS NOT NULL AS known, d.whole, {_code('a.word')} AS code FROM all_words a LEFT JOIN spoken USING (word) LEFT JOIN divided d USING (word))
      SELECT CASE WHEN NOT known THEN 'not spellable' WHEN whole IS NULL THEN 'no division' WHEN NOT whole THEN 'relaxed tables' WHEN {_starts(CONSTRAINTS[0][1])} + {_starts(CONSTRAINTS[1][1])} > 0 THEN 'hard constraint' ELSE 'none' END AS issue, count(*) AS n FROM j GROUP BY 1""",
    "word_ipa": _IPA,
    "phoneme_pmi_extremes": f"""WITH {_SPOKEN}, {_GRAMS.format('tokens')}, m AS (SELECT x, y, n, log2(CAST(n AS DOUBLE) * sum(n) OVER () / (CAST(sum(n) OVER (PARTITION BY x) AS DOUBLE) * sum(n) OVER (PARTITION BY y))) AS pmi FROM counts),
      r AS (SELECT *, row_number() OVER (ORDER BY round(pmi, 9) DESC, x, y) AS a, row_number() OVER (ORDER BY round(pmi, 9), x, y) AS b FROM m WHERE n >= 2)
      SELECT 'top' AS side, a AS place, x, y, n, round(pmi, 6) AS pmi FROM r WHERE a <= 30 UNION ALL SELECT 'bottom', b, x, y, n, round(pmi, 6) FROM r WHERE b <= 30""",
    "vowel_feature_agreement": f"""WITH {_SPOKEN}, {_VCV}, {_FEATURE_ROWS}, sides AS (SELECT x, sum(n) AS n FROM (SELECT u AS x, n FROM vcv UNION ALL SELECT v, n FROM vcv) GROUP BY x),
      s AS (SELECT feature, value, CAST(sum(n) AS DOUBLE) AS n FROM sides JOIN feats USING (x) GROUP BY 1, 2), chance AS (SELECT feature, sum(n * n) / (sum(n) * sum(n)) AS chance FROM s GROUP BY feature),
      m AS (SELECT c, a.feature, sum(n) AS n, sum(CASE WHEN a.value = b.value THEN n ELSE 0 END) AS same FROM vcv JOIN feats a ON a.x = u JOIN feats b ON b.x = v AND b.feature = a.feature GROUP BY 1, 2)
      SELECT c, feature, CAST(n AS BIGINT) AS n, round(same / CAST(n AS DOUBLE), 6) AS agreement, round(chance, 6) AS chance, CASE WHEN same / CAST(n AS DOUBLE) - chance > 0.1 THEN '+' WHEN same / CAST(n AS DOUBLE) - chance < -0.1 THEN '-' ELSE '' END AS mark FROM m JOIN chance USING (feature) WHERE n >= 10""",
    "top10_variants": f"""WITH {_LEX}, l AS (SELECT lang, symbol, sum(n) AS n FROM (SELECT lang, unnest(string_split(word, '')) AS symbol, n FROM lex) GROUP BY 1, 2),
      t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, symbol) AS r FROM l) WHERE r <= 10), s AS (SELECT lang, string_agg(symbol, '' ORDER BY symbol) AS letters, sum(n) AS tokens FROM t GROUP BY lang)
      SELECT lang, 'truncate' AS mode, letters, CAST(sum(n) AS BIGINT) AS words, CAST(any_value(tokens) AS BIGINT) AS tokens FROM lex JOIN s USING (lang) GROUP BY lang, letters
      UNION ALL SELECT lang, 'only', letters, CAST(sum(n) AS BIGINT), CAST(sum(n * length(word)) AS BIGINT) FROM lex JOIN s USING (lang) WHERE len(list_filter(string_split(word, ''), lambda c: NOT contains(letters, c))) = 0 GROUP BY lang, letters""",
    "sequence_hits": f"""WITH {_SPOKEN}, f(form, sounds) AS (VALUES ('c', ['c']), ('t', ['t']), ('an', ['a', 'n']), ('tsa', ['ts', 'a'])),
      h AS (SELECT word, n, form, list_transform(list_filter(range(1, len(tokens) - len(sounds) + 2), lambda i: array_to_string(tokens[i:i + len(sounds) - 1], ' ') = array_to_string(sounds, ' ')), lambda i: length(array_to_string(tokens[1:i - 1], ''))) AS places FROM spoken, f)
      SELECT word, n, form, array_to_string(places, ',') AS offsets FROM h WHERE len(places) > 0""",
    "word_rank_stats": f"""WITH {_LEX}, r AS (SELECT lang, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS r, n / CAST(sum(n) OVER (PARTITION BY lang) AS DOUBLE) AS f FROM lex)
      SELECT lang, count(*) AS n_types, CAST(sum(n) AS BIGINT) AS n_tokens, round(sum(CASE WHEN r <= 10 THEN f ELSE 0 END), 6) AS top_share, round(max(f), 6) AS top1, round(-sum(f * log2(f)), 6) AS h_bits, round(-sum(f * log2(f)) / log2(count(*)), 6) AS h_rel, round(1 / sum(r * f), 9) AS p_geo FROM r GROUP BY lang""",
    "lang_js_divergence": f"""WITH {_LEX}, c AS (SELECT 'word' AS unit, lang, word AS symbol, n FROM lex UNION ALL SELECT 'letter', lang, symbol, sum(n) FROM (SELECT lang, n, unnest(string_split(word, '')) AS symbol FROM lex) GROUP BY lang, symbol),
      f AS (SELECT unit, lang, symbol, n / CAST(sum(n) OVER (PARTITION BY unit, lang) AS DOUBLE) AS f FROM c), {_JS} SELECT unit, left_lang AS "left", right_lang AS "right", round(js, 6) AS js FROM js""",
    "lang_summary_ratios": f"""WITH {_LEX}, s AS (SELECT lang, n, {_code('word')} AS code FROM lex WHERE array_to_string({_TOKENS}, '') = word),
      t AS (SELECT lang, sum(n) AS words, sum(n * length(code)) AS seg, """ + ", ".join(f"sum(n * length(regexp_replace(code, '[^{_set(m)}]', '', 'g'))) AS {k}" for k, m in (("v", VOWELS), ("o", MEMBERS["O"]), ("vo", [p for p in MEMBERS["O"] if PHONEMES[p]["voi"]]), ("r", MEMBERS["R"]))) + """ FROM s GROUP BY lang)
      SELECT lang, CAST(words AS BIGINT) AS words, round(v / CAST(seg AS DOUBLE), 6) AS vowel_share, round(vo / CAST(o AS DOUBLE), 6) AS voiced_share, round(r / CAST(seg - v AS DOUBLE), 6) AS sonorant_share, round(seg / CAST(words AS DOUBLE), 6) AS mean_length FROM t""",
    "cv_clusters": f"WITH {_SPOKEN}, r AS (SELECT n, unnest(regexp_extract_all(word, '(?:{'|'.join(DIGRAPHS)}|[{''.join(p for p in CONSONANTS if len(p) == 1)}]){{2,}}')) AS symbol FROM spoken) SELECT symbol, CAST(sum(n) AS BIGINT) AS n FROM r WHERE length({_code('symbol')}) > 1 GROUP BY symbol",
    "cv_counts": f"WITH {_SPOKEN} SELECT translate({_code('word')}, '{_set(VOWELS)}{_set(CONSONANTS)}', '{'V' * len(VOWELS)}{'C' * len(CONSONANTS)}') AS skeleton, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_types FROM spoken GROUP BY 1",
    "phoneme_tokenise": f"WITH {_LEX} SELECT word, CAST(sum(n) AS BIGINT) AS n, array_to_string({_TOKENS}, ' ') AS tokens, array_to_string({_TOKENS}, '') = word AS accepted FROM lex GROUP BY word",
    "phoneme_distribution": f"WITH {_SPOKEN}, p AS (SELECT p, sum(n) AS n FROM (SELECT unnest(tokens) AS p, n FROM spoken) GROUP BY p), t AS (" + " UNION ALL ".join(f"SELECT '{k}' AS tier, {_case('p', v)} AS symbol, n FROM p" for k, v in _TIER_SQL.items()) + "), c AS (SELECT tier, symbol, CAST(sum(n) AS BIGINT) AS n FROM t GROUP BY 1, 2) SELECT tier, symbol, n, round(n / CAST(sum(n) OVER (PARTITION BY tier) AS DOUBLE), 6) AS freq FROM c",
    "phoneme_bigrams": f"WITH {_SPOKEN}, {_GRAMS.format('tokens')} SELECT x, y, n, CASE WHEN n >= 2 THEN round(log2(CAST(n AS DOUBLE) * sum(n) OVER () / (CAST(sum(n) OVER (PARTITION BY x) AS DOUBLE) * sum(n) OVER (PARTITION BY y))), 6) END AS pmi FROM counts",
    "class_bigrams": f"WITH {_SPOKEN}, {_GRAMS.format('list_transform(tokens, lambda p: ' + _case('p', CLASS_OF) + ')')}, cx AS (SELECT x, sum(n) AS nx FROM counts GROUP BY x), cy AS (SELECT DISTINCT y FROM counts) SELECT cx.x, cy.y, coalesce(n, 0) AS n, round(CAST((coalesce(n, 0) + 0.1) / (nx + 0.1 * (SELECT count(*) FROM cy)) AS DOUBLE), 6) AS p_smooth, round(coalesce(n, 0) / CAST(nx AS DOUBLE), 6) AS p_raw FROM cx CROSS JOIN cy LEFT JOIN counts c ON c.x = cx.x AND c.y = cy.y",
    "vowel_harmony": _HARM,
    "pattern_count": f"WITH {_SPOKEN}, e AS (SELECT n, {_code('word')} AS code FROM spoken), v AS (SELECT n, " + ", ".join(f"{_starts(p)} AS v{i}" for i, (_, p) in enumerate(_PATTERNS)) + " FROM e) " + " UNION ALL ".join(f"SELECT '{k}' AS name, CAST(sum(v{i} * n) AS BIGINT) AS matches, CAST(sum(CASE WHEN v{i} > 0 THEN n ELSE 0 END) AS BIGINT) AS words FROM v" for i, (k, _) in enumerate(_PATTERNS)),
    "constraint_violations": f"WITH {_SPOKEN}, e AS (SELECT word, n, {_code('word')} AS code FROM spoken) SELECT word, n, " + ", ".join(f"{_starts(p)} AS {k.lower().replace('-', '_')}" for k, p, _ in CONSTRAINTS) + " FROM e",
    "harmony_rank": f"WITH {_SPOKEN}, e AS (SELECT n, {_code('word')} AS code FROM spoken), v AS (SELECT n, {_starts(CONSTRAINTS[0][1])} + {_starts(CONSTRAINTS[1][1])} AS hard, {_starts(CONSTRAINTS[2][1])} AS soft FROM e) SELECT CASE WHEN hard > 0 THEN 'excluded' ELSE printf('%.1f', 4.0 * soft) END AS harmony, count(*) AS n_types, CAST(sum(n) AS BIGINT) AS n FROM v GROUP BY 1",
    "page_markers": "WITH t AS (SELECT page_id, regexp_extract_all(coalesce(html, ''), '<(!--|[a-zA-Z][a-zA-Z0-9]*)', 1) AS tags FROM pages), p AS (SELECT tags, unnest(range(1, len(tags) + 1)) AS i FROM t) SELECT coalesce(tags[i + 1], '(end)') AS next, count(*) AS n FROM p WHERE tags[i] = '!--' GROUP BY 1",
}
ORACLES |= _BASELINES

_TEXT = "array_to_string(list_transform(s, lambda x: x.o || x.v || x.c), '.')"
_ORDER = "list_transform(s, lambda x: 100 * length(x.o) + 10 * length(x.v) + length(x.c))"
_ASKED = f"spoken AS (SELECT word, 1 AS n FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark) WHERE array_to_string({_TOKENS}, '') = word)"
ORACLES["divisions"] = f"""{_divided_sql(_ASKED)}, ways AS (SELECT word, code, s, true AS legal FROM strict_cut WHERE pos > length(code) UNION ALL SELECT word, code, s, false FROM relaxed_cut WHERE pos > length(code))
  SELECT word, row_number() OVER (PARTITION BY word ORDER BY {_ORDER}) - 1 AS place, {_spelled(_TEXT)} AS divided, legal FROM ways"""
_CODAS = "SELECT word, s FROM {0}_cut WHERE pos > length(code) QUALIFY row_number() OVER (PARTITION BY word ORDER BY list_sum(list_transform(s, lambda x: length(x.c))) DESC, len(s), " + _ORDER + ") = 1"
ORACLES["best_by"] = f"""{_DIVIDED}, codas AS (SELECT * FROM ({_CODAS.format('strict')}) UNION ALL SELECT * FROM ({_CODAS.format('relaxed')}))
  SELECT word, {_spelled(_TEXT.replace('(s,', '(d.s,'))} AS by_onset, {_spelled(_TEXT.replace('(s,', '(c.s,'))} AS by_coda FROM divided d JOIN codas c USING (word)"""


def _accent_rules_sql() -> str:
    weights = {"rime": "length(x.c)", "onset": "length(x.c) + greatest(length(x.o) - 1, 0)", "katakana": "least(length(x.c), 1) + greatest(length(x.o) - 1, 0)"}
    rules = {
        "first_heavy": "coalesce(list_position(list_transform(w, lambda x: x >= 2), true), 1)", "heaviest": "list_position(w, list_max(w))",
        "last_heavy": "coalesce(len(w) + 1 - list_position(list_transform(list_reverse(w), lambda x: x >= 2), true), len(w))",
    }
    weighed = " UNION ALL ".join(f"SELECT *, '{k}' AS scale, list_transform(s, lambda x: CASE WHEN length(x.v) > 1 THEN 2 ELSE 1 END + {w}) AS w FROM heard" for k, w in weights.items())
    tested = " UNION ALL ".join(f"SELECT *, '{k}' AS rule, {w} - 1 = fall AS hit FROM weighed" for k, w in rules.items())
    return f"""{_DIVIDED}, heard AS (SELECT s, n, fall, CASE WHEN length(word) % 2 = 0 THEN 'F' ELSE 'HL' END AS kind FROM (SELECT *, {_fall('onset_sensitive')} AS fall FROM divided) WHERE length(word) % 2 = 0 OR fall < len(s) - 1),
  weighed AS ({weighed}), tested AS ({tested})
  SELECT kind, rule, scale, CAST(sum(n) AS BIGINT) AS n, CAST(sum(CASE WHEN hit THEN n ELSE 0 END) AS BIGINT) AS hits, CAST(sum(CASE WHEN w[fall + 1] >= 2 THEN n ELSE 0 END) AS BIGINT) AS on_heavy,
    round(sum(CASE WHEN hit THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE), 6) AS share FROM tested GROUP BY 1, 2, 3"""


ORACLES["accent_rules"] = _accent_rules_sql()
ORACLES["blind_stimuli"] = f"""WITH {_SPOKEN}, base AS (SELECT word, row_number() OVER (ORDER BY md5('5:order:' || word), word) - 1 AS rank, count(*) OVER () AS n FROM spoken),
  picked AS (SELECT * FROM base WHERE rank + 20 <= n QUALIFY row_number() OVER (ORDER BY md5('5:repeat:' || word), word) <= CAST(floor(n * 0.1) AS BIGINT)),
  slots AS (SELECT word, rank AS slot, false AS is_repeat FROM base UNION ALL SELECT word, rank + 20 + CAST('0x' || substr(md5('5:slot:' || word), 1, 12) AS BIGINT) % (n - rank - 20 + 1), true FROM picked),
  others AS (SELECT *, row_number() OVER (ORDER BY slot, is_repeat DESC, md5('5:tie:' || word), word) AS i FROM slots),
  free AS (SELECT p, row_number() OVER (ORDER BY p) AS i FROM (SELECT unnest(range(1, (SELECT count(*) FROM others) + {len(_ANCHORS) + 1})) AS p) WHERE p NOT IN ({', '.join(str(p) for _, p in _ANCHORS)})),
  placed AS (SELECT p AS place, word, is_repeat, false AS is_anchor FROM others JOIN free USING (i) UNION ALL SELECT * FROM (VALUES {', '.join(f"({p}, '{w}', false, true)" for w, p in _ANCHORS)}))
  SELECT place, substr(sha1(word), 1, 8) AS id, word, is_repeat, is_anchor FROM placed"""
