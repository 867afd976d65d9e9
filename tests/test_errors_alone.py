"""Errors told without making the recipes are those of the recipes."""

import json

from brigade.operators import html, plain


def test_errors_alone_equal_those_of_recipes():
    good = {"@type": "Recipe", "name": "Riz", "recipeIngredient": ["200 g de riz", "sel"], "recipeInstructions": ["Cuire.", "Servir."]}
    odd = [{}, {"name": " "}, {"name": None}, {"recipeIngredient": ["sel", "  "]}, {"recipeInstructions": ["Cuire", "12)"]}, {"recipeYield": [4]}, {"@type": "x"}]
    seen = set()
    for change in odd:
        text = f'<script type="application/ld+json">{json.dumps(good | change)}</script>'
        for url in ("https://a.b/", "::", None):
            for failed in (None, "Request failed: 404"):
                for over in ((None, None, None), (" ", None, ""), ("a", "b", "c")):
                    page = html.read_page(text, url)
                    error = plain.whole(page, text, failed, over)["error"]
                    assert plain.error_alone(page, text, failed, over) == error
                    seen.add(error)
    assert {None, "No recipe data found", "Unable to derive recipe name", "Not enough ingredients extracted", "Not enough steps extracted", "Yield has no text", "Invalid: source_name, source_attribution"} <= seen
