"""Document-domain tables rendered from the given business tables, one document per source row.

Nothing is grouped to render a text, so no key can make a document or a task grow.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from turnstone.sources.files import read_table


def mad(cents: Column) -> Column:
    """Cents as ``1 234.56 MAD``."""
    return F.concat(F.replace(F.format_number(cents / 100, 2), F.lit(","), F.lit(" ")), F.lit(" MAD"))


def cents_of(amount: Column) -> Column:
    return F.round(F.abs(amount) * 100).cast("bigint")


def _doc(key: Column, kind: int) -> Column:
    return (key * 4 + kind).cast("bigint")


def _ref(prefix: str, year: Column, key: Column) -> Column:
    return F.concat(F.lit(prefix + "-"), year.cast("string"), F.lit("-"), F.format_string("%06d", key % 1000000))


def _day(ts: Column) -> Column:
    return F.date_format(ts, "dd/MM/yyyy")


def _text(*lines) -> Column:
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p]) for p in lines])


class DocumentTables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return read_table(self.spark, self.folder, name)

    @cached_property
    def invoice_source(self) -> DataFrame:
        ttc = cents_of(F.col("o_totalprice"))
        rows = self.read("orders").select("o_orderkey", "o_custkey", "o_orderdate", ttc.alias("ttc"))
        rows = rows.withColumn("ht", F.floor(F.col("ttc") * 10 / 12)).withColumn("qty", F.col("o_orderkey") % 9 + 1)
        rows = rows.withColumn("pu", F.floor(F.col("ht") / F.col("qty")))
        return rows.select(
            _doc(F.col("o_orderkey"), 0).alias("doc_id"), "o_custkey", "qty",
            _ref("INV", F.year("o_orderdate"), F.col("o_orderkey")).alias("reference"),
            F.col("o_orderdate").alias("issued"), F.date_add("o_orderdate", 30).alias("due"),
            mad(F.col("ht")).alias("ht"), mad(F.col("ttc") - F.col("ht")).alias("tva"), mad(F.col("ttc")).alias("ttc"),
            mad(F.col("pu")).alias("pu"), mad(F.col("pu") * F.col("qty")).alias("line1"),
            mad(F.col("ht") - F.col("pu") * F.col("qty")).alias("line2"),
        )

    @cached_property
    def invoices(self) -> DataFrame:
        s = self.invoice_source
        c, cust = F.col, F.col("o_custkey").cast("string")
        text = _text(
            "FACTURE", ["Reference: ", c("reference")], ["Date: ", _day(c("issued"))], ["Echeance: ", _day(c("due"))],
            "FOURNISSEUR CLIENT", ["ATLAS FOURNITURES AU COMPTOIR ", cust],
            ["12 avenue Atlas Maroc  ", cust, " rue des Ateliers Maroc"],
            "Designation Qte PU Total",
            ["Support utilisateur ", c("qty").cast("string"), " ", c("pu"), " ", c("line1")],
            ["Frais de dossier 1 ", c("line2"), " ", c("line2")],
            "CONDITIONS DE PAIEMENT", "Paiement a 30 jours.", "TOTAUX",
            ["Total HT: ", c("ht")], ["TVA 20%: ", c("tva")], ["Total TTC: ", c("ttc")], "Devise: MAD",
        )
        data = F.concat(
            F.lit('{"numero_facture":"'), c("reference"), F.lit('","client_name":"COMPTOIR '), cust,
            F.lit('","date":"'), _day(c("issued")), F.lit('","total":"'), c("ttc"),
            F.lit('","mail":" ","extra":{"taux_tva":"20","items":[{"libelle":"Support utilisateur","qte":"'),
            c("qty").cast("string"), F.lit('","prix":"'), c("pu"), F.lit('","total":"'), c("line1"), F.lit('"}]}}'),
        )
        return s.select("doc_id", F.lit("invoice").alias("kind"), text.alias("raw_text"), data.alias("data"),
                        c("issued").cast("timestamp_ntz").alias("date_uploaded"))

    @cached_property
    def statements(self) -> DataFrame:
        bal = cents_of(F.col("c_acctbal")) + 500000
        s = self.read("customer").select("c_custkey", "c_name", bal.alias("bal"))
        c = F.col
        text = _text(
            "RELEVE DE COMPTE", ["Reference: ", _ref("STM", F.lit(2024), c("c_custkey"))], "INFORMATIONS COMPTE",
            "Banque: Banque Centrale", ["Titulaire: ", c("c_name")],
            ["Compte: 00", F.format_string("%010d", c("c_custkey"))],
            ["IBAN: MA64 0000 0000 ", F.format_string("%010d", c("c_custkey")), " 00"],
            "Periode: du 01/02/2024 au 29/02/2024", "Date Libelle Debit Credit Solde",
            ["02/02/2024 Achat carte 100.00 MAD ", mad(c("bal") - 10000)],
            ["10/02/2024 Virement recu 250.00 MAD ", mad(c("bal") + 15000)],
            ["20/02/2024 Operation mixte 10.00 MAD 20.00 MAD ", mad(c("bal") + 16000)],
            "SYNTHESE PERIODE", "Total debit: 110.00 MAD", "Total credit: 270.00 MAD",
            ["Solde debut: ", mad(c("bal"))], ["Solde fin: ", mad(c("bal") + 16000)],
        )
        data = F.concat(F.lit('{"data":{"full_name":"'), c("c_name"), F.lit('","amount":"'), mad(c("bal") + 16000),
                        F.lit('"},"bank":"Banque Centrale"}'))
        return s.select(_doc(c("c_custkey"), 1).alias("doc_id"), F.lit("bank_statement").alias("kind"),
                        text.alias("raw_text"), data.alias("data"),
                        (F.lit("2024-03-01").cast("timestamp_ntz") + F.make_interval(mins=(c("c_custkey") % 40000).cast("int"))).alias("date_uploaded"))

    @cached_property
    def receipts(self) -> DataFrame:
        s = self.read("events").select("event_id", "user_id", "ts", cents_of(F.col("value")).alias("amount"))
        c = F.col
        ref = _ref("TXN", F.lit(2024), c("event_id"))
        fees = F.lit(150)
        text = _text(
            "RECU DE PAIEMENT", ["Reference: ", ref], "DETAILS RECU", ["Date: ", _day(c("ts"))],
            ["Heure: ", F.date_format("ts", "HH:mm:ss")], "Canal: En ligne", "Statut: Execute",
            "PAYEUR BENEFICIAIRE", ["Client ", c("user_id").cast("string"), "  Parking Central"],
            ["Compte: ", F.format_string("%012d", c("user_id")), "  Compte: 990000000001"],
            "MONTANTS ET MOTIF", "Motif: Stationnement", ["Montant: ", mad(c("amount"))], ["Frais: ", mad(fees)],
            ["Total debite: ", mad(c("amount") + fees)], "Devise: MAD", "INFORMATIONS TRANSACTION",
            ["Transaction ID: ", ref], ["Auth code: ", F.format_string("%06d", c("event_id") % 1000000)],
            "Canal securise: Oui",
        )
        data = F.concat(F.lit('{"name":"Client '), c("user_id").cast("string"), F.lit('","amount":"'), mad(c("amount")),
                        F.lit('","Address":"12 rue du Port","email":"c'), c("user_id").cast("string"),
                        F.lit('@example.org","canal":"En ligne"}'))
        return s.select(_doc(c("event_id"), 2).alias("doc_id"), F.lit("payment_receipt").alias("kind"),
                        text.alias("raw_text"), data.alias("data"), c("ts").alias("date_uploaded"))

    @cached_property
    def wires(self) -> DataFrame:
        s = self.read("supplier").select("s_suppkey", "s_name", "s_nationkey", (cents_of(F.col("s_acctbal")) + 100).alias("amount"))
        c = F.col
        text = _text(
            "ORDRE DE VIREMENT", ["Reference: ", _ref("TRF", F.lit(2024), c("s_suppkey"))], "EMETTEUR",
            "Nom: Societe Atlas", "Banque: Banque Populaire", "Compte: 001122334455", "Adresse: 5 avenue Atlas",
            "BENEFICIAIRE", ["Nom: ", c("s_name")], ["Banque beneficiaire: Banque ", c("s_nationkey").cast("string")],
            ["IBAN: MA64 0000 1111 ", F.format_string("%010d", c("s_suppkey"))], ["RIB: ", F.format_string("%012d", c("s_suppkey"))],
            "DETAILS VIREMENT", "Motif: Reglement", ["Montant: ", mad(c("amount"))], ["Frais: ", mad(F.lit(2500))],
            ["Total: ", mad(c("amount") + 2500)], "Devise: MAD", "EXECUTION", "Date ordre: 05/02/2024",
            "Date execution: 07/02/2024", "Statut: Execute",
        )
        data = F.concat(F.lit('{"nom":"'), c("s_name"), F.lit('","montant":"'), mad(c("amount") + 2500), F.lit('","extra":{"tva":"0%"}}'))
        return s.select(_doc(c("s_suppkey"), 3).alias("doc_id"), F.lit("wire_transfer").alias("kind"),
                        text.alias("raw_text"), data.alias("data"),
                        (F.lit("2024-02-07").cast("timestamp_ntz") + F.make_interval(mins=c("s_suppkey").cast("int") % 40000)).alias("date_uploaded"))

    @cached_property
    def ocr(self) -> DataFrame:
        """All rendered documents."""
        return self.invoices.unionByName(self.statements).unionByName(self.receipts).unionByName(self.wires)

    @cached_property
    def texts(self) -> DataFrame:
        """Prose documents and rendered ones in one id space."""
        prose = self.read("documents").select((-F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("raw_text"))
        return prose.unionByName(self.ocr.select("doc_id", "raw_text"))

    @cached_property
    def lines(self) -> DataFrame:
        """Lines with boxes: 16 units per line, 30 more before each shouted line."""
        rows = self.ocr.select("doc_id", "kind", F.posexplode(F.split("raw_text", "\n")).alias("line_no", "text"))
        y = F.col("line_no") * 20 + F.when(F.col("line_no") >= 7, 30).otherwise(0)
        return rows.select(
            "doc_id", "kind", F.lit(1).alias("page"), "line_no", "text",
            F.lit(20.0).alias("x0"), y.cast("double").alias("y0"),
            (F.length("text") * 7 + 20).cast("double").alias("x1"), (y + 14).cast("double").alias("y1"),
        )

    @cached_property
    def pages(self) -> DataFrame:
        """One row per page with the boxes of ``lines`` in an array, in reading order."""
        def box(text: Column, n: Column) -> Column:
            y = n * 20 + F.when(n >= 7, 30).otherwise(0)
            return F.struct(
                y.cast("double").alias("y0"), F.lit(20.0).alias("x0"), n.alias("line_no"), text.alias("text"),
                (F.length(text) * 7 + 20).cast("double").alias("x1"), (y + 14).cast("double").alias("y1"))

        return self.ocr.select("doc_id", "kind", F.lit(1).alias("page"), F.transform(F.split("raw_text", "\n"), box).alias("lines"))

    @cached_property
    def split_lines(self) -> DataFrame:
        """Labels and values as boxes of their own, side by side."""
        side = F.array(
            F.struct(F.lit(0).alias("side"), F.substring_index("text", ": ", 1).alias("text"), F.lit(20.0).alias("x0"), F.lit(150.0).alias("x1")),
            F.struct(F.lit(1).alias("side"), F.substring_index("text", ": ", -1).alias("text"), F.lit(200.0).alias("x0"), F.lit(420.0).alias("x1")),
        )
        rows = self.lines.filter(F.col("text").contains(": ")).select("doc_id", "kind", "page", "line_no", "y0", "y1", F.explode(side).alias("s"))
        return rows.select("doc_id", "kind", "page", (F.col("line_no") * 2 + F.col("s.side")).alias("line_no"),
                           F.col("s.text").alias("text"), F.col("s.x0").alias("x0"), "y0", F.col("s.x1").alias("x1"), "y1")

    @cached_property
    def box_rows(self) -> DataFrame:
        """One row per document with the boxes of ``split_lines`` in an array."""
        def sides(l: Column) -> Column:
            box = lambda side, part, x0, x1: F.struct(
                F.lit(1).alias("page"), (l["line_no"] * 2 + side).alias("line_no"), F.substring_index(l["text"], ": ", part).alias("text"),
                F.lit(x0).alias("x0"), l["y0"].alias("y0"), F.lit(x1).alias("x1"), l["y1"].alias("y1"))
            return F.array(box(0, 1, 20.0, 150.0), box(1, -1, 200.0, 420.0))

        labelled = F.filter("lines", lambda l: l["text"].contains(": "))
        return self.pages.select("doc_id", "kind", F.flatten(F.transform(labelled, sides)).alias("boxes"))

    @cached_property
    def tokens(self) -> DataFrame:
        """Words of the invoices with boxes and a reading confidence."""
        lines = self.lines.filter("kind = 'invoice'")
        rows = lines.select("doc_id", "page", "line_no", "y0", F.posexplode(F.split("text", " ")).alias("pos", "text"))
        conf = (F.col("doc_id") * 7 + F.col("line_no") * 13 + F.col("pos") * 29) % 100
        x = F.col("pos") * 90 + 20
        return rows.select(
            "doc_id", "page", "line_no", "pos", "text", conf.cast("int").alias("conf"),
            x.cast("int").alias("x0"), (F.col("y0") + F.col("pos") % 3).cast("int").alias("y0"),
            (x + F.length("text") * 8).cast("int").alias("x1"), (F.col("y0") + F.col("pos") % 3 + 12).cast("int").alias("y1"),
            (F.col("line_no") + 1).cast("int").alias("line_id"), F.lit(1).alias("block_num"),
            (F.col("line_no") / 8).cast("int").alias("par_num"), (F.col("line_no") % 8).cast("int").alias("line_num"),
        )

    @cached_property
    def token_lines(self) -> DataFrame:
        """One row per line of ``tokens`` with its words in an array."""
        def word(text: Column, pos: Column) -> Column:
            x, y = pos * 90 + 20, F.col("y0") + pos % 3
            conf = (F.col("doc_id") * 7 + F.col("line_no") * 13 + pos * 29) % 100
            return F.struct(
                x.cast("int").alias("x0"), pos.alias("pos"), text.alias("text"), F.col("line_no").alias("line_no"), conf.cast("int").alias("conf"),
                y.cast("int").alias("y0"), (x + F.length(text) * 8).cast("int").alias("x1"), (y + 12).cast("int").alias("y1"))

        return self.lines.filter("kind = 'invoice'").select(
            "doc_id", "page", (F.col("line_no") + 1).cast("int").alias("line_id"), F.transform(F.split("text", " "), word).alias("words"))

    @cached_property
    def token_pages(self) -> DataFrame:
        """One row per page with the words of ``tokens`` that clustering needs in an array."""
        def words(line: Column, n: Column) -> Column:
            top = n * 20 + F.when(n >= 7, 30).otherwise(0)
            return F.transform(F.split(line, " "), lambda text, pos: F.struct(
                (top + pos % 3).cast("double").alias("y"), (pos * 90 + 20).cast("int").alias("x0"), n.alias("line_no"), pos.alias("pos"), text.alias("text")))

        return self.invoices.select("doc_id", F.lit(1).alias("page"), F.flatten(F.transform(F.split("raw_text", "\n"), words)).alias("words"))
