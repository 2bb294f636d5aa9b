"""Stopword tiers for German curriculum text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words of administration and instruction.
ADMIN = """
schülerinnen schüler schülerin schule kompetenz kompetenzen kompetenzerwartungen sachkompetenz urteilskompetenz
methodenkompetenz handlungskompetenz unterricht fach themen hinweise bildung grundlage grundlagen aspekte bezüge lernenden
erläutern beschreiben beurteilen reflektieren analysieren erklären bewerten erkennen diskutieren vergleichen unterscheiden
darstellen kennen std ustd stunde bzw btv ggf halbjahr oberstufe einführungsphase qualifikationsphase hauptphase sek
ministerium thüringer herausgeber kapitel anderer hinweis besonderer jeweilig anhand folgend ständig vorschlag
""".split()
# Scraps of text extraction.
ARTIFACTS = "gv lt ca tf ak le sowie usw vgl schlerinnen schler fr".split()
# Function words of German; the list of a language library can take its place.
GERMAN = """
aber alle allem allen aller alles als also am an ander andere anderem anderen anderer anderes auch auf aus bei beim bin bis bist
da damit dann das dass dein deine dem den denn der des dessen dich die dies diese diesem diesen dieser dieses dir doch dort du
durch ein eine einem einen einer eines er es etwas euch euer für gegen gewesen hab habe haben hat hatte hatten hier hin hinter
ich ihm ihn ihnen ihr ihre ihrem ihren ihrer im in ins ist ja jede jedem jeden jeder jedes jener kann kein keine können man
manche mehr mein mich mir mit muss nach nicht nichts noch nun nur ob oder ohne sehr sein seine seinem seinen seiner selbst sich
sie sind so soll sollen sollte sondern über um und uns unser unter viel vom von vor war waren warum was weg weil weiter welche
wenn wer werden wie wieder will wir wird wo wurde zu zum zur zwar zwischen
""".split()
# Instruction terms stripped from raw text to focus on its content.
STRIP_TERMS = [
    "schülerinnen", "schüler", "schülerin", "kompetenz", "kompetenzen", "kompetenzerwartungen",
    "erläutern", "erläutert", "beschreiben", "beschreibt", "beurteilen", "beurteilt", "reflektieren", "reflektiert",
    "analysieren", "analysiert", "erklären", "erklärt", "bewerten", "bewertet", "erkennen", "erkennt",
    "diskutieren", "diskutiert", "vergleichen", "vergleicht", "unterscheiden", "unterscheidet", "darstellen", "stellt dar",
    "kennen", "kennt", "können", "sollen",
]


def base_stopwords(language_words: list[str] | None = None) -> list[str]:
    """Union of the tiers, lower case, sorted."""
    own = GERMAN if language_words is None else language_words
    return sorted({w.lower() for w in (*own, *ADMIN, *ARTIFACTS)})


def stopword_table(dictionary: DataFrame, base: list[str] | None = None) -> DataFrame:
    """concept, word: the base list for every concept of dictionary(lemma, variant), and its own variants in lower case."""
    words = F.array(*[F.lit(w) for w in (base if base is not None else base_stopwords())])
    concepts = dictionary.select(F.col("lemma").alias("concept")).distinct()
    common = concepts.select("concept", F.explode(words).alias("word"))
    own = dictionary.select(F.col("lemma").alias("concept"), F.lower("variant").alias("word"))
    return common.union(own).distinct()
