"""Rule sets for common page kinds: data, not code.

Fixed values: the element ids and classes these public sites use.
"""

from __future__ import annotations

from weblode.operators.select import Field, Pick, Step
from weblode.plans.jobs import RuleSet

_id = lambda name: (Step(id=name),)
_cls = lambda *names: tuple(Step(classes=(n,)) for n in names)

MARKET_PRODUCT = RuleSet(
    fields=(
        Field("title", Pick((_id("productTitle"),), "own")),
        Field("price", Pick((_cls("a-price", "a-offscreen"),), "own")),
        Field("rating", Pick((_id("acrPopover"),), "attr:title")),
        Field("reviews", Pick((_id("acrCustomerReviewText"),), "own")),
        Field("brand", Pick((_id("bylineInfo"),), "own")),
        Field("bullets", Pick(((Step(id="feature-bullets"), Step(tag="li"), Step(tag="span")),), "own"), many=True),
        Field("image", Pick((_id("landingImage"),), "attr:src")),
        Field("asin", Pick((_id("ASIN"),), "attr:value")),
    ),
)
MARKET_SEARCH = RuleSet(
    each=((Step(attrs=(("data-component-type", "=", "s-search-result"),)),),),
    fields=(
        Field("asin", Pick((), "attr:data-asin")),
        Field("title", Pick(((Step(tag="h2"), Step(tag="span")),), "own")),
        Field("price", Pick((_cls("a-price", "a-offscreen"),), "own")),
        Field("rating", Pick((_cls("a-icon-alt"),), "own")),
    ),
)
JOB_CARDS = RuleSet(
    each=(_cls("base-search-card"),),
    fields=(
        Field("position", Pick((_cls("base-search-card__title"),), "own")),
        Field("company", Pick((_cls("base-search-card__subtitle"),))),
        Field("location", Pick((_cls("job-search-card__location"),), "own")),
        Field("date", Pick(((Step(tag="time"),),), "attr:datetime")),
        Field("url", Pick(((Step(tag="a", classes=("base-card__full-link",)),),), "attr:href")),
    ),
)
