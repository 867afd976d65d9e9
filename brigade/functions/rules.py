"""Enumerations, keyword lists and site data that results must agree with."""

from __future__ import annotations

UNITS = ["g", "kg", "ml", "l", "unit", "cs", "cc", "pincee"]

#: Store aisles, in the order in which their rules are tried.
AISLE_RULES = [
    ("boucherie_poisson", ["boeuf", "veau", "porc", "poulet", "dinde", "agneau", "jambon", "lardon", "saucisse", "saumon", "thon", "poisson", "crevette", "crabe", "homard"]),
    ("cremerie", ["lait", "beurre", "creme", "fromage", "yaourt", "yoghourt", "oeuf", "oeufs"]),
    ("fruits_legumes", ["tomate", "oignon", "ail", "carotte", "courgette", "aubergine", "poivron", "pomme", "banane", "citron", "orange", "fraise", "salade", "epinard", "champignon", "asperge", "brocoli", "chou", "concombre"]),
    ("boulangerie", ["pain", "baguette", "brioche"]),
    ("surgeles", ["surgele", "congele"]),
    ("boissons", ["vin", "biere", "jus", "sirop"]),
    ("entretien", ["papier", "aluminium", "film alimentaire", "liquide vaisselle"]),
    ("epicerie", ["farine", "sucre", "sel", "poivre", "riz", "pate", "pates", "huile", "vinaigre", "levure", "chocolat", "cacao", "epice", "epices", "lentille", "pois chiche", "haricot"]),
]
AISLES = ["fruits_legumes", "boucherie_poisson", "cremerie", "epicerie", "surgeles", "boulangerie", "boissons", "entretien", "autres"]

#: Allergens, in the order in which they are reported.
ALLERGEN_RULES = [
    ("gluten", ["farine", "ble", "pate", "pates", "pain", "semoule", "biscuit", "gateau", "couscous", "seigle", "orge", "avoine"]),
    ("lactose", ["lait", "beurre", "creme", "fromage", "yaourt", "yoghourt", "lactose"]),
    ("oeuf", ["oeuf", "oeufs"]),
    ("arachide", ["arachide", "cacahuete", "cacahuetes"]),
    ("fruits_a_coque", ["noix", "noisette", "noisettes", "amande", "amandes", "cajou", "pistache", "pecan", "macadamia"]),
    ("soja", ["soja"]),
    ("poisson", ["poisson", "saumon", "thon", "cabillaud", "sardine", "maquereau", "anchois"]),
    ("crustaces", ["crustace", "crevette", "crevettes", "crabe", "homard"]),
    ("sesame", ["sesame"]),
]
ALLERGENS = [name for name, _ in ALLERGEN_RULES]

SEASONAL = ["asperge", "potimarron", "courge", "marron", "chataigne", "girolle", "morille", "cepe", "rhubarbe", "cerise", "fraise", "figue", "artichaut"]
NOT_VEGETARIAN = ["boeuf", "bœuf", "poulet", "dinde", "porc", "jambon", "lardon", "saucisse", "saumon", "thon", "poisson", "crevette", "crabe", "homard", "gelatine", "anchois"]
BATCH_PHRASES = ["batch cooking", "meal prep", "se conserve", "se garde", "a l'avance", "la veille", "preparer a l'avance", "congeler", "congelation", "congelateur", "se congele", "rechauffer", "se rechauffe"]

NUMBER_WORDS = {"un": 1, "une": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "six": 6, "sept": 7, "huit": 8, "neuf": 9, "dix": 10}
FRACTIONS = {"¼": "1/4", "½": "1/2", "¾": "3/4", "⅓": "1/3", "⅔": "2/3", "⅛": "1/8", "⅜": "3/8", "⅝": "5/8", "⅞": "7/8"}

ENGINE_HOST = "duckduckgo.com"
ENGINE_URL = "https://duckduckgo.com/html/?q="
#: id, name, host suffix, search URL before the query, what stands before the query's words; licence and attribution: proprietary and the name.
SITES = [
    ("marmiton", "Marmiton", "marmiton.org", "https://www.marmiton.org/recettes/recherche.aspx?aqt=", ""),
    ("750g", "750g", "750g.com", "https://www.750g.com/recherche/?q=", ""),
    ("cuisineaz", "CuisineAZ", "cuisineaz.com", "https://www.cuisineaz.com/recettes/recherche_terme.aspx?recherche=", ""),
    ("ptitchef", "Ptitchef", "ptitchef.com", ENGINE_URL, "site:ptitchef.com recette "),
    ("cuisineactuelle", "Cuisine Actuelle", "cuisineactuelle.fr", ENGINE_URL, "site:cuisineactuelle.fr recette "),
    ("journaldesfemmes", "Journal des Femmes", "journaldesfemmes.fr", ENGINE_URL, "site:cuisine.journaldesfemmes.fr recette "),
]
FALLBACK_SITES = ["750g", "cuisineaz"]
LICENSE, UNKNOWN_LICENSE = "proprietary", "unknown"
