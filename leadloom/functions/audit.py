"""What an audit finds on pages: signatures, issues with their priorities, scores. Native columns over texts and page facts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom.functions.reviews import is_json

# Signs, providers, weights.
BLOCK_SIGNS = (
    "country blocked", "access denied", "attention required", "checking your browser", "just a moment", "cf-error-details", "please verify you are a human",
    "request blocked", "you have been blocked", "sorry, you have been blocked", "ddos protection by", "this website is using a security service",
    "blocked by geolocation", "geo restricted", "geoblocked", "unusual traffic from your computer network", "verifying your browser", "verifying you are human",
    "verifying your connection", "please wait while we verify", "please enable javascript to continue", "redirecting you", "you will be redirected",
    "you are being redirected", "click here if you are not redirected", "one moment please", "please wait...", "loading, please wait",
)
CHALLENGE_SIGNS = (
    "cdn-cgi/challenge-platform", "challenges.cloudflare.com", "cf_chl_opt", "cf-turnstile", "turnstile", "__cf_chl_rt_tk", "jschl_answer", "cf-please-wait",
    "captcha-delivery.com", "geo.captcha-delivery.com", "distil_r_captcha", "px-captcha", "akamai-bmp", "hcaptcha.com/captcha", "recaptcha/api.js",
)
CHATBOTS = {
    "Intercom": ("widget.intercom.io", "intercomcdn.com"), "Drift": ("js.driftt.com", "drift.com/api"), "Tidio": ("code.tidio.co",), "Zendesk Chat": ("ekr.zdassets.com", "zopim.com"),
    "LiveChat": ("cdn.livechatinc.com",), "Crisp": ("client.crisp.chat",), "Tawk.to": ("embed.tawk.to",), "HubSpot Chat": ("js.usemessages.com", "hubspot-messages-iframe"),
    "Freshchat": ("wchat.freshchat.com", "freshchat.com"), "Olark": ("static.olark.com",), "ManyChat": ("widget.manychat.com",), "Chatbot.com": ("chatbot.com/widget",),
    "Facebook Messenger Plugin": ("fb-customerchat", "customerchat", "m.me/"), "Smartsupp": ("smartsuppchat.com",), "JivoChat": ("code.jivosite.com", "jivo.chat"),
    "Gupshup / WATI / Interakt": ("wati.io", "interakt.ai", "gupshup.io"),
}
WHATSAPP_SIGNS = ("wa.me/", "api.whatsapp.com/", "web.whatsapp.com/send", "wa.link/", "whatsapp://send", "chat.whatsapp.com/")
BOOKING_SIGNS = (
    "calendly.com", "acuityscheduling.com", "squareup.com/appointments", "booksy.com", "setmore.com", "appointlet.com", "simplybook.me", "vagaro.com", "fresha.com",
    "book-now", "book an appointment", "schedule an appointment", "schedule a consultation", "book a free trial", "book your free trial", "book a trial", "free trial",
    "book a class", "book your class", "book a session", "book now", "book online", "class schedule", "mindbodyonline.com", "healcode", "cultfit", "zenoti.com",
    "fitnessforce", "gymmaster", "glofox.com", "booking-form", "online booking",
)
TRUST_SIGNS = (
    "testimonial", "testimonials", "reviews", "customer review", "client review", "what our clients say", "what our members say", "success stories", "verified by",
    "as seen in", "5 star", "5-star", "★★★★★", "trusted by", "google reviews", "rated",
)
TRUST = r"(?<![a-z])(?:" + "|".join(re.escape(k) for k in TRUST_SIGNS) + r")(?![a-z])"
JS_REDIRECT = r"(?i)(?:window\.location(?:\.href)?\s*=|location\.replace\s*\()"
SECURITY_HEADERS = ("Strict-Transport-Security", "Content-Security-Policy", "X-Frame-Options", "X-Content-Type-Options", "Referrer-Policy", "Permissions-Policy")
LOCAL_TYPES = ("LocalBusiness", "Dentist", "MedicalBusiness", "MedicalOrganization", "Restaurant", "Store", "Organization")
SOCIAL_HOSTS = ("facebook.com", "instagram.com", "linkedin.com", "twitter.com", "x.com", "youtube.com", "youtu.be", "justdial.com")
JUNK_FRAGMENTS = ("example.", "sentry", "wixpress", "@2x", ".png", ".jpg", ".webp", "yourdomain", "domain.com")
IGNORED_LINKS = ("/cdn-cgi/l/email-protection",)
OPPORTUNITY_WEIGHTS = {"has_chatbot": 25, "has_lead_form": 15, "has_whatsapp": 15, "has_phone_cta": 10, "has_appointment_booking": 15, "has_trust_signals": 10}
HEALTH_WEIGHTS = {"performance": 20, "seo_technical": 20, "accessibility": 15, "ux_technical": 15, "security": 10, "technical_health": 10, "local_schema": 10}


def first_sign(text: Column, signs: tuple[str, ...]) -> Column:
    """The first of the signs, in their order, that the lower-case text holds; null without one."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(s)), F.lit(s)) for s in signs])


def has_sign(text: Column, signs: tuple[str, ...]) -> Column:
    """Whether the lower-case text holds one of the signs: one alternation, compiled once."""
    return text.rlike("|".join(re.escape(s) for s in signs))


def block_sign(title: Column, body: Column) -> Column:
    """The sign of a block page in the title and the first 2000 characters of the text: the rule's reach."""
    return first_sign(F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.left(F.coalesce(body, F.lit("")), F.lit(2000)))), BLOCK_SIGNS)


def challenge_sign(html: Column) -> Column:
    """The sign of a challenge page in the first 20000 characters of its source: the rule's reach."""
    return first_sign(F.lower(F.left(F.coalesce(html, F.lit("")), F.lit(20000))), CHALLENGE_SIGNS)


def chatbots(html: Column) -> Column:
    """The chat providers whose signs the source holds."""
    low = F.lower(F.coalesce(html, F.lit("")))
    return F.array_compact(F.array(*[F.when(has_sign(low, signs), F.lit(name)) for name, signs in CHATBOTS.items()]))


def needs_render(html: Column, is_shell: Column) -> Column:
    return is_shell | F.coalesce(html, F.lit("")).rlike(JS_REDIRECT)


def missing_headers(names: Column) -> Column:
    """The security headers that a page's header names (any case) lack."""
    have = F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda n: F.lower(n))
    return F.filter(F.array(*map(F.lit, SECURITY_HEADERS)), lambda h: ~F.array_contains(have, F.lower(h)))


def _issue(when: Column, category: str, problem: str | Column, priority: str | Column) -> Column:
    text = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(category).alias("category"), text(problem).alias("problem"), text(priority).alias("priority")))


def issues(*found: Column) -> Column:
    """The issues that hold, in the order given."""
    return F.array_compact(F.array(*found))


def header_issue(missing: Column) -> Column:
    grave = F.arrays_overlap(missing, F.array(*map(F.lit, SECURITY_HEADERS[:2])))
    return _issue(F.size(missing) > 0, "Security", "Missing security headers.", F.when(grave, "HIGH").otherwise("MEDIUM"))


def ssl_issues(valid: Column, days_left: Column) -> list[Column]:
    return [_issue(~valid, "Security", "SSL certificate is invalid or missing.", "CRITICAL"), _issue(valid & (days_left < 21), "Security", "SSL certificate is about to expire.", "HIGH")]


def site_issues(robots: Column, sitemap: Column, favicon: Column, redirects: Column) -> list[Column]:
    return [
        _issue(~redirects, "Security", "HTTP does not redirect to HTTPS.", "HIGH"), _issue(~robots, "Technical SEO", "No robots.txt found.", "LOW"),
        _issue(~sitemap, "Technical SEO", "No XML sitemap found.", "MEDIUM"), _issue(~favicon, "Technical Health", "No favicon found.", "LOW"),
    ]


def conversion_issues(chat: Column, whatsapp: Column, booking: Column, form: Column, form_fields: Column, phone: Column, trust: Column) -> list[Column]:
    return [
        _issue(~chat, "Automation Opportunity", "No AI chatbot or live-chat widget detected.", "HIGH"), _issue(~whatsapp, "Automation Opportunity", "No WhatsApp click-to-chat link detected.", "MEDIUM"),
        _issue(~booking, "Conversion", "No appointment/booking system detected.", "MEDIUM"), _issue(~form, "Conversion", "No lead-capture form detected.", "HIGH"),
        _issue(form & (form_fields > 7), "Conversion", "Lead-capture form is long.", "LOW"), _issue(~phone, "Conversion", "No clickable phone (tel:) link detected.", "MEDIUM"),
        _issue(~trust, "Conversion", "No visible trust signals (testimonials/reviews) detected.", "MEDIUM"),
    ]


def seo_issues(f: Column) -> list[Column]:
    """The technical issues of a page by its facts (see page.page_facts)."""
    title, meta = F.length(F.coalesce(f["title"], F.lit(""))), F.length(F.trim(F.coalesce(f["meta_description"], F.lit(""))))
    return [
        _issue(title == 0, "SEO", "Page is missing a <title> tag.", "HIGH"), _issue((title > 0) & ~title.between(10, 60), "SEO", "Title tag length is outside the recommended range.", "LOW"),
        _issue(meta == 0, "SEO", "Page is missing a meta description.", "MEDIUM"), _issue((meta > 0) & ~meta.between(50, 160), "SEO", "Meta description length is outside the recommended range.", "LOW"),
        _issue(~f["has_viewport"], "Mobile", "No mobile viewport meta tag.", "CRITICAL"), _issue(f["h1_count"] != 1, "SEO", "Page does not have exactly one H1.", "LOW"),
        _issue((f["img_total"] > 0) & (f["img_missing_alt"] >= f["img_total"] * 0.2), "Accessibility", "Many images are missing alt text.", "MEDIUM"),
        _issue(F.lower(f["robots_meta"]).contains("noindex"), "SEO", "Page is set to noindex.", "CRITICAL"), _issue(~f["has_canonical"], "SEO", "No canonical tag found.", "LOW"),
    ]


def lighthouse_issues(performance: Column, opportunities: Column) -> Column:
    """Of a page's performance score and what could make it faster, the first five."""
    own = F.array_compact(F.array(_issue(performance < 50, "Performance", "Mobile page-load performance is poor.", "CRITICAL"), _issue((performance >= 50) & (performance < 90), "Performance", "Mobile page-load performance has room to improve.", "MEDIUM")))
    more = F.transform(F.slice(F.coalesce(opportunities, F.array().cast("array<string>")), 1, 5), lambda t: F.struct(F.lit("Performance").alias("category"), F.substring_index(t, ":", 1).alias("problem"), F.lit("MEDIUM").alias("priority")))
    return F.concat(own, more)


def link_issues(links: Column, page_chars: Column, broken: Column, forbidden: Column) -> list[Column]:
    return [
        _issue((links < 8) & (page_chars > 3000), "Technical SEO", "Few internal links found.", "LOW"),
        _issue(broken > 0, "Technical Health", "Broken internal links found.", F.when(broken > 2, "HIGH").otherwise("MEDIUM")), _issue(forbidden > 0, "Technical Health", "Some internal links are forbidden.", "LOW"),
    ]


def _tenth(c: Column) -> Column:
    """Half-even to one digit, as binary doubles are rounded."""
    return F.bround(c, 1)


def _passed(*checks: Column) -> Column:
    return sum((F.coalesce(c, F.lit(False)).cast("int") for c in checks[1:]), F.coalesce(checks[0], F.lit(False)).cast("int"))


def score_performance(mobile: Column, desktop: Column) -> Column:
    """0.6 of the mobile and 0.4 of the desktop score; where one is missing the other's part over 0.6."""
    pct = F.when(mobile.isNotNull() & desktop.isNotNull(), mobile * 0.6 + desktop * 0.4).otherwise(F.coalesce(mobile * 0.6, desktop * 0.4, F.lit(0.0)) / 0.6)
    return _tenth(pct / 100 * HEALTH_WEIGHTS["performance"])


def score_accessibility(pct: Column) -> Column:
    return _tenth(F.coalesce(pct, F.lit(0.0)) / 100 * HEALTH_WEIGHTS["accessibility"])


def score_seo(f: Column, lighthouse: Column) -> Column:
    """Six checks, half and half with the lighthouse score where that was run."""
    title, meta = F.length(F.coalesce(f["title"], F.lit(""))), F.length(F.trim(F.coalesce(f["meta_description"], F.lit(""))))
    alt = (f["img_total"] == 0) | (f["img_missing_alt"] / F.greatest(f["img_total"], F.lit(1)) < 0.2)
    passed = _passed(title.between(10, 60), meta.between(50, 160), f["has_canonical"], f["h1_count"] == 1, alt, ~F.coalesce(F.lower(f["robots_meta"]).contains("noindex"), F.lit(False)))
    manual = passed / 6 * 100
    return _tenth(F.when(lighthouse.isNull(), manual).otherwise(lighthouse * 0.5 + manual * 0.5) / 100 * HEALTH_WEIGHTS["seo_technical"])


def score_ux(f: Column) -> Column:
    return _tenth(_passed(f["has_viewport"], f["h1_count"] >= 1) / 2 * 100 / 100 * HEALTH_WEIGHTS["ux_technical"])


def score_security(valid: Column, n_headers: Column, insecure: Column, redirect: Column) -> Column:
    """Passed over made: certificate and six headers, plus mixed content and redirect where these were checked (not null)."""
    made = 7 + insecure.isNotNull().cast("int") + redirect.isNotNull().cast("int")
    return _tenth((_passed(valid, insecure == 0, redirect) + n_headers) / made * HEALTH_WEIGHTS["security"])


def score_technical(robots: Column, sitemap: Column, favicon: Column, broken: Column, checked: Column) -> Column:
    whole = F.when(checked > 0, F.greatest(F.lit(0.0), 1 - broken / checked)).otherwise(1.0)
    return _tenth((_passed(robots, sitemap, favicon) + whole) / 4 * HEALTH_WEIGHTS["technical_health"])


def score_opportunity(schema_parts: Column) -> Column:
    """The weights of the flags that are true, and ten for how many of the four parts of a local schema are there."""
    flags = sum((F.when(F.col(f), w).otherwise(0) for f, w in OPPORTUNITY_WEIGHTS.items()), F.lit(0))
    return flags + _tenth(schema_parts / 4 * 10)


def jsonld_nodes(data: Column) -> Column:
    """The objects of a JSON-LD text: of its @graph, of a list, or itself, each as JSON; empty for what is no JSON."""
    text = F.trim(data)
    graph = F.get_json_object(text, "$.@graph")
    listed = F.when(~is_json(text), F.array().cast("array<string>")).when(graph.startswith("["), F.from_json(graph, "array<string>")).when(text.startswith("["), F.from_json(text, "array<string>")).when(text.startswith("{"), F.array(text))
    return F.filter(F.coalesce(listed, F.array().cast("array<string>")), lambda n: F.trim(n).startswith("{"))


def local_schema(nodes: Column) -> Column:
    """struct(types, name, telephone, address, rating, hours) over all nodes: types that hold a local one's name, the first name,
    telephone and address, whether there is a rating and opening hours."""
    get = lambda n, k: F.get_json_object(n, f"$.{k}")
    kinds = F.flatten(F.transform(nodes, lambda n: F.coalesce(F.from_json(get(n, "@type"), "array<string>"), F.array(get(n, "@type")))))
    first = lambda values: F.get(F.filter(values, lambda v: F.coalesce(v, F.lit("")) != ""), F.lit(0))
    parts = ("streetAddress", "addressLocality", "addressRegion", "postalCode")
    address = lambda n: F.when(get(n, "address").startswith("{"), F.concat_ws(", ", *[F.nullif(get(n, f"address.{k}"), F.lit("")) for k in parts])).otherwise(get(n, "address"))
    return F.struct(
        F.filter(kinds, lambda t: t.rlike("|".join(LOCAL_TYPES))).alias("types"), first(F.transform(nodes, lambda n: get(n, "name"))).alias("name"),
        first(F.transform(nodes, lambda n: get(n, "telephone"))).alias("telephone"), first(F.transform(nodes, address)).alias("address"),
        F.exists(nodes, lambda n: get(n, "aggregateRating").isNotNull()).alias("rating"), F.exists(nodes, lambda n: get(n, "openingHoursSpecification").isNotNull() | get(n, "openingHours").isNotNull()).alias("hours"),
    )


def page_emails(hrefs: Column, text: Column) -> Column:
    """Mail links first, then addresses in the text: lower case, each once, none with a junk fragment, at most five."""
    mail = F.transform(F.filter(hrefs, lambda h: h.rlike("(?i)^mailto:")), lambda h: F.trim(F.substring_index(F.coalesce(F.try_url_decode(F.replace(F.substr(h, F.lit(8)), F.lit("+"), F.lit("%2B"))), F.substr(h, F.lit(8))), "?", 1)))
    said = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})"), 1)
    low = F.transform(F.concat(F.coalesce(mail, F.array().cast("array<string>")), said), lambda e: F.lower(e))
    return F.slice(F.array_distinct(F.filter(low, lambda e: (e != "") & ~has_sign(e, JUNK_FRAGMENTS))), 1, 5)


def ignorable_link(url: Column) -> Column:
    return has_sign(url, IGNORED_LINKS)
