"""Rule tables of the page classifier: patterns on lower-cased text, each with its weight."""

from __future__ import annotations

#: Titles by family.
TITLES = [
    ("ANNONCE_CW", r"annonce\s+arriv", 8),
    ("ANNONCE_CW_INV", r"inventory\s+request\s+report", 8),
    ("ANNONCE_CW_LISTE", r"transit\s+list\s+of\s+items", 7),
    ("TRANSIT_LISTE", r"liste\s+d.articles|transit\s*[-–]\s*liste", 6),
    ("TRANSIT_LISTE", r"elenco\s+degli\s+articoli\s*[-–.]*\s*transito", 6),
    ("TRANSIT_FR", r"transit\s*[-–]\s*document\s+d.accompagnement", 7),
    ("TRANSIT_TCH", r"d[ée]claration\s+de\s+marchandises\s+en\s+transit\s+national", 8),
    ("TRANSIT_TAD", r"document\s+d.accompagnement\s+transit", 7),
    ("TRANSIT_TAD", r"transit\s+accompanying\s+document", 7),
    ("TRANSIT_TAD", r"documento\s+di\s+accompagnamento\s+transito", 7),
    ("TRANSIT_TAD", r"unione\s+europea|'nione\s+europea|un\.}cne\s+europea", 6),
    ("TRANSIT_TAD", r"tipo\s+di\s+dichiarazione|tipo\s+dioichia", 6),
    ("TRANSIT_TAD", r"type\s+de\s+d[ée]claration", 5),
    ("TRANSIT_TAD", r"nombre\s+et\s+nature\s+des\s+colis", 4),
    ("TRANSIT_TAD", r"titulaire\s+du\s+r[ée]gime\s+de\s+transit", 4),
    ("TRANSIT_TAD", r"titolare\s+del\s+regime\s+di\s+transito", 4),
    ("TRANSIT_TAD", r"bureau\s+de\s+destination", 3),
    ("TRANSIT_TAD", r"ufficio\s+doganale\s+di\s+destinazione|ufficio\s+doganale\s+di\s+partenza", 3),
]
#: Anchors, counted only beside a title.
ANCHORS = [
    (r"\bgdrn\b", 5),
    (r"d[ée]lai\s+de\s+transit", 4),
    (r"titulaire\s+du\s+r[ée]gime\s+de\s+transit", 4),
    (r"titolare\s+del\s+regime\s+di\s+transito", 4),
    (r"principal\s+oblig[ée]", 3),
    (r"exemplaire\s+de\s+renvoi|esemplare\s+per\s+il\s+rinvio", 3),
    (r"r[ée]gime\s+de\s+transit|regime\s+di\s+transito", 3),
    (r"masse\s+brute|massa\s+lorda", 3),
    (r"\bt2l\b|\bt2f\b", 4),
]
#: The type box, on the text as written.
TYPE_BOX, TYPE_WEIGHT = r"(?m)^\s*(T1|T2|T2L|T2F)\s*$|\b(?:type|tipo)\b[^\n]{0,40}\b(T1|T2L|T2F|T2)\b", 4
#: Signs against a transit page, by kind.
AGAINST = {
    "export": [
        (r"export\s+accompanying\s+document", 8),
        (r"document\s+d.accompagnement[- ]?export", 8),
        (r"wywozowy\s+dokument\s+towarzysz", 8),
        (r"ausfuhrbegleitdokument", 8),
        (r"eu\s+export\s+declaration", 8),
        (r"d[ée]claration\s+d.exportation", 7),
        (r"\bex\s?1\b|\bex\s?a\b|\bex\s?d\b", 3),
    ],
    "annex": [
        (r"proforma\s+invoice|commercial\s+invoice|packing\s+list|facture\s+proforma", 5),
        (r"\bwaybill\s+doc\b|air\s+waybill|\bawb\b\s*no|\bwaybill\b\s*[\d ]{8,}", 4),
        (r"\bcmr\b|consignment\s+note|lettre\s+de\s+voiture", 4),
        (r"from:\s|sent:\s|subject:|objet\s*:", 5),
        (r"certificate\s+of\s+origin|eur\.?1\b", 4),
        (r"dokument\s+e-?ad|\bad\b\s*dokument|administrative\s+accompanying", 6),
        (r"prohl[áa]šení|celn[íi]\s+prohl", 4),
    ],
    "cover": [
        (r"g[ée]n[ée]rateur\s+de\s+balayage", 5),
        (r"nombre\s+d.enregistrements", 5),
        (r"ce\s+document\s+sert\s+d.outil", 4),
        (r"swiss-app\.dhl\.com", 4),
    ],
}
#: What makes a list page the first page of a European declaration.
LIST_TOTALS = r"totale\s+(?:articoli|dei\s+colli|massa)"
LIST_HEADER = r"unione\s+europea|'nione\s+europea|tipo\s+di\s+dichiarazione"
#: Words of a goods table.
RICH = r"\b(description|designation|quantit|qty|unit price|total|hs code|tariff|commodity|goods|invoice|proforma|facture|marchandise|weight|poids|gross|net)\b"
#: Rank of a family when two readings of a page compete.
RANK = {"INDETERMINE": 0, "ENVELOPPE": 1, "ANNEXE": 1, "EXPORT": 2}
#: Families without transit data.
OFF_TOPIC = ("EXPORT", "ANNEXE", "ENVELOPPE", "INDETERMINE")
#: Families a model reads first, and next.
FIRST_READ = ("TRANSIT_TAD", "TRANSIT_TCH", "TRANSIT_FR", "ANNONCE_CW", "ANNONCE_CW_INV")
SECOND_READ = ("ANNONCE_CW_LISTE", "TRANSIT_LISTE")
#: The labels of transport facts and what a model calls them.
TRANSPORT_LABELS = [
    (r"v[ée]hicule|mode|means of transport", "Véhicule / mode"),
    (r"scell[ée]|seal", "Scellés"),
    (r"pays de destination|country of destin", "Pays de destination"),
    (r"terme ultime|ultimate", "Terme ultime"),
    (r"garantie|guarantee", "Garantie"),
    (r"bureau de d[ée]part|office of departure", "Bureau de départ"),
    (r"bureau de destination|office of destin", "Bureau de destination"),
    (r"masse brute|gross mass|poids brut", "Masse brute totale"),
    (r"masse nette|net mass|poids net", "Masse nette totale"),
    (r"colis|package|parcel", "Nbre de colis"),
    (r"conteneur|container", "N° de conteneur"),
    (r"exp[ée]dition|shipment", "Réf. d'expédition"),
]
#: A vehicle names its way of transport.
VEHICLE = r"(?i)route|rail|fer|mer|maritim|air|a[ée]rien|postal|camion|wagon|navire|avion|routier"
#: What stands before a commodity code inside a designation.
CODE_PREFIX = r"(?i)[,;]?\s*(?:tc|t\.c|ta|code|hs|nc|sh)\s*[:.]?\s*"
#: The older finder with four classes.
FOUR_FOR = [
    (r"d[ée]claration de marchandises en transit", 6),
    (r"transit national", 5),
    (r"document d.accompagnement[- ]?transit", 6),
    (r"transit accompanying document", 6),
    (r"begleitdokument[- ]?versand|versandbegleitdokument", 6),
    (r"titulaire du r[ée]gime de transit", 4),
    (r"\bgdrn\b", 3),
    (r"d[ée]lai de transit", 3),
    (r"bureau de destination", 2),
    (r"principal oblig[ée]", 2),
    (r"\bt2l\b|\bt2f\b", 4),
]
FOUR_TYPE, FOUR_TYPE_WEIGHT = r"(?m)\btype\b[^\n]{0,40}\b(t1|t2|t2l|t2f)\b|\bdeclaration\b[^\n]{0,20}\b(t1|t2)\b|^\s*(t1|t2|t2l|t2f)\s*$", 5
FOUR_EXPORT = [
    (r"export accompanying document", 8),
    (r"document d.accompagnement[- ]?export", 8),
    (r"wywozowy dokument towarzysz", 8),
    (r"ausfuhrbegleitdokument", 8),
    (r"eu export declaration", 8),
    (r"d[ée]claration d.exportation", 7),
    (r"\bead\b", 5),
]
FOUR_OTHER = [
    (r"dokument e-?ad|e-?ad\b|administrative accompanying", 6),
    (r"proforma invoice|commercial invoice|packing list", 5),
    (r"\bcmr\b|consignment note|lettre de voiture", 4),
    (r"air waybill|\bawb\b\s*no", 3),
    (r"from:\s|sent:\s|subject:|objet\s*:", 4),
    (r"certificate of origin|eur\.?1", 4),
]
FOUR_MOVEMENT = r"(?i)\b\d{2}[A-Z]{2}[0-9A-Z]{12,}"
FOUR_SWISS = r"transit national|\bgdrn\b"
