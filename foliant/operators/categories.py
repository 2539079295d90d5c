"""Categories of documents: by the kind of file, by keywords, by vectors, and by hand."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions import names
from foliant.functions import text as t
from foliant.functions.vectors import cosine
from foliant.operators import relational

# Topic categories and their keywords.
TAXONOMY: dict[str, list[str]] = {
    "administration": "administration,formulaire,attestation,certificat,impot,impôt,steuer,finanzamt,antrag,bescheinigung,urssaf,caf,prefecture,préfecture,meldebescheinigung,certificate,form".split(","),
    "legal": "contrat,contract,vertrag,tribunal,court,jugement,avocat,lawyer,anwalt,clause,litige,assignation,procedure,procédure,recht,gesetz,agreement".split(","),
    "finance": "facture,invoice,rechnung,iban,bank,compte,konto,budget,impot,steuer,assurance,versicherung,bilan,revenu,einkommen,statement,payment,paiement".split(","),
    "work_career": "emploi,job,candidature,cv,lebenslauf,bewerbung,recrutement,recruiter,apec,france travail,arbeitsamt,stage,internship,career,linkedin,entretien,interview".split(","),
    "health": "sante,santé,medecin,médecin,ordonnance,pharmacie,gesundheit,arzt,rezept,apotheke,medical,clinic,analyse,cholesterol,vaccin".split(","),
    "technology": "software,code,python,database,docker,api,algorithm,neural,machine learning,kubernetes,linux,github,hardware,server,cloud,technologie,datenbank".split(","),
    "education": "formation,cours,course,ecole,école,schule,universite,université,universität,student,diplome,diplôme,master,bootcamp,training,certification".split(","),
    "personal": "famille,family,familie,maman,papa,anniversaire,vacances,holiday,urlaub,message,lettre,brief,photo,mariage".split(","),
    "real_estate": "appartement,immobilier,loyer,miete,wohnung,bail,lease,propriete,propriété,syndic,copropriete,copropriété,terrain,veranda,habitation".split(","),
    "travel": "voyage,travel,reise,billet,ticket,train,flug,flight,hotel,reservation,réservation,booking,airport,bahnhof".split(","),
    "shopping": "commande,order,bestellung,achat,purchase,kauf,facture,receipt,livraison,lieferung,amazon,boutique".split(","),
    "media": "photo,image,musique,music,musik,film,video,vidéo,audiobook,livre,buch,book,podcast".split(","),
}


def by_keywords(df: DataFrame, key: str, text: str, taxonomy: Mapping[str, Sequence[str]], threshold: float = 1.0) -> DataFrame:
    """(key, category, score): distinct keywords that a text holds, a hundred words, from the threshold on; 1 at most.
    A keyword of one word must be a whole word of the text; one with blanks may stand anywhere. No shuffle: the
    taxonomy, a parameter, is part of the projection."""
    rows = df.select(key, F.lower(F.coalesce(text, F.lit(""))).alias("low"), t.latin_tokens(F.col(text)).alias("all"))
    rows = rows.select(key, "low", F.array_distinct("all").alias("words"), F.greatest(F.size("all"), F.lit(1)).alias("n"))

    def hits(keywords):
        single = [k.lower() for k in keywords if " " not in k]
        out = F.size(F.array_intersect("words", F.array(*map(F.lit, single)))) if single else F.lit(0)
        for k in keywords:
            if " " in k:
                out = out + F.contains("low", F.lit(k.lower())).cast("int")
        return out

    scored = rows.select(key, F.explode(F.create_map(*[x for name, ks in taxonomy.items() for x in (F.lit(name), 100.0 * hits(ks) / F.col("n"))])).alias("category", "score"))
    return scored.filter((F.col("score") >= threshold) & (F.col("score") > 0)).withColumn("score", F.round(F.least(F.lit(1.0), "score"), 3))


def by_vectors(df: DataFrame, key: str, vector: str, centres: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(key, category, score): categories whose vector (category, vector; a row a category, so broadcast) is similar."""
    pairs = df.select(key, F.col(vector).alias("_v")).crossJoin(F.broadcast(centres.select("category", F.col("vector").alias("_c"))))
    return pairs.select(key, "category", F.round(cosine(F.col("_v"), F.col("_c")), 3).alias("score")).filter(F.col("score") >= threshold)


def classified(df: DataFrame, key: str, text: str, extension: str, taxonomy: Mapping[str, Sequence[str]] = TAXONOMY, semantic: DataFrame | None = None, most: int = 3) -> DataFrame:
    """(key, category, score, source): the structural category, and the best topics, by keywords or vectors; the better score
    of a category counts, ties by name."""
    kind = names.by_extension(F.col(extension), names.STRUCTURE, None)
    every = df.select(key, kind.alias("category"), F.lit(1.0).alias("score"), F.lit("structural").alias("source")).filter("category is not null")
    every = every.unionByName(by_keywords(df, key, text, taxonomy).select(key, "category", "score", F.lit("keyword").alias("source")))
    if semantic is not None:
        every = every.unionByName(semantic.select(key, "category", "score", F.lit("semantic").alias("source")))
    best = every.groupBy(key, "category").agg(F.max(F.struct("score", "source")).alias("b")).select(key, "category", "b.score", "b.source")
    best = best.withColumn("_kind", F.when(F.col("source") == "structural", "structural").otherwise("topic"))
    by = F.concat_ws(":", F.col(key).cast("string"), "_kind")
    ranked = relational.top_per_group(best.withColumn("_by", by), "_by", [F.col("score").desc(), F.col("category")], most)
    return ranked.select(key, "category", "score", "source")


def overridden(found: DataFrame, manual: DataFrame, key: str) -> DataFrame:
    """found after decisions by hand (key, category, include): included ones with score 1, excluded ones gone."""
    kept = found.join(manual.select(key, "category"), [key, "category"], "left_anti")
    return kept.unionByName(manual.filter("include").select(key, "category", F.lit(1.0).alias("score"), F.lit("manual").alias("source")).select(kept.columns))
