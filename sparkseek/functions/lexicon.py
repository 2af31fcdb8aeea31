"""Word lists and constants that decide results. All of them are fixed values."""

# English stop words of the analyzer (lower-case fragments as the tokenizer leaves them).
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself
it its itself they them their theirs themselves what which who whom this that these those am is are was were be
been being have has had having do does did doing a an the and but if or because as until while of at by for with
about against between into through during before after above below to from up down in out on off over under again
further then once here there when where why how all any both each few more most other some such no nor not only
own same so than too very s t can will just don should now d ll m o re ve y ain aren couldn didn doesn hadn hasn
haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn
""".split()

# Topic keywords.
TOPIC_KEYWORDS = ["geology", "sedimentary", "igneous", "metamorphic", "stratigraphy", "tectonic", "mineral", "volcano", "earthquake", "petrology", "geochronology", "fault", "plate tectonics"]

# Words of a URL's path or query that mark a utility page.
UTILITY_WORDS = """
about accessibility account admin careers comment comments contact cookie donate faq feedback help jobs legal login
logout media newsletter press privacy profile register search signin signup subscribe support terms
""".split()

# Title phrases of utility pages, for pages that are indexed and for pages that are crawled.
UTILITY_TITLES_INDEX = ["contact us", "privacy policy", "terms of use", "terms and conditions", "media contacts"]
UTILITY_TITLES_CRAWL = ["contact us", "privacy policy", "terms of use", "terms and conditions", "login", "sign in", "sign up", "media contacts"]

# Query parameters that normalisation drops.
TRACKING_PREFIX = "utm_"
TRACKING_PARAMS = ["gclid", "fbclid", "msclkid", "yclid", "mc_cid", "mc_eid"]

# Elements of a page that are removed before anything is read from it.
CHROME_TAGS = ["script", "style", "noscript", "template", "svg", "canvas", "nav", "header", "footer", "aside", "form"]

# Colours of clusters, by their number.
PALETTE = ["#C8A96E", "#5EC4B0", "#8B78E8", "#4285F4", "#00B4D8", "#E05C5C", "#81b29a", "#f2cc8f"]

# Irregular forms of the stemmer.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning",
    "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
