"""Values that have to be exactly these for results to be right.

Nothing here is logic.  Word lists, selector values, column headings, messages
and bounds are stated as plain text so they can be read and checked at a glance.
"""

# The blogging site whose URL shapes and texts are recognised.
SITE = "medium.com"
SITE_URL = "https://medium.com"
IMAGE_HOST_URL = "https://miro.medium.com"

# Reading speed, access-barrier threshold, session gap, text bounds.
WORDS_PER_MINUTE = 200
TRUNCATION_THRESHOLD = 500
CONFIDENCE_PER_INDICATOR = 0.25
SESSION_GAP_MINUTES = 30
PREVIEW_LENGTH = 200
MAX_SLUG_LENGTH = 255
DEFAULT_KEYWORDS = 10
DEFAULT_SUMMARY_SENTENCES = 3
CASCADE_MIN_PART = 10
CASCADE_MIN_TOTAL = 50

# Request contract.
DEFAULT_MAX_POSTS = 10
MIN_MAX_POSTS = 1
MAX_MAX_POSTS = 1000
DEFAULT_REQUESTS_PER_SECOND = 1.0
MIN_REQUESTS_PER_SECOND = 0.1
MAX_REQUESTS_PER_SECOND = 5.0
OUTPUT_FORMATS = ("json", "csv", "xlsx")
SORT_ORDERS = ("latest", "popular", "oldest")

# Whitespace as browsers define it.
WS = (
    r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
)
ZERO_WIDTH = r"[\x{200B}-\x{200D}]"

# Words never reported as keywords.
STOP_WORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with",
    "by", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had",
    "do", "does", "did", "will", "would", "could", "should", "may", "might", "must",
    "this", "that", "these", "those", "i", "you", "he", "she", "it", "we", "they",
    "me", "him", "her", "us", "them", "my", "your", "his", "its", "our", "their",
)

# The 24 export columns.
EXPORT_COLUMNS = (
    "Article Title", "Article Subtitle", "Article URL", "Author Name", "Author URL",
    "Publication Date", "Reading Time (minutes)", "Claps", "Responses", "Tags",
    "Publication Name", "Publication URL", "Main Image URL", "Is Premium",
    "Series Name", "Series Part", "Word Count", "Keywords", "Hashtags", "Mentions",
    "Content Summary", "Comments Count", "Paywall Type", "Scraped At",
)

# The eleven headings of the report, and its texts where there is nothing to show.
REPORT_COLUMNS = (
    "Title", "Author", "Date", "Reading Time", "Claps", "Responses", "Tags", "Publication", "Premium",
    "Word Count", "URL",
)
NO_ARTICLES = "No articles found"
NO_AUTHOR = "Unknown Author"

# Names of the eight session counters in the metric report.
METRIC_NAMES = (
    "Session Duration", "Articles Scraped", "Errors", "Warnings", "Retries",
    "Paywall Hits", "Proxy Changes", "Success Rate",
)

# HTML character references written by the report, in replacement order.
HTML_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))

# Character references understood when reading markup; "&amp;" goes last.
HTML_ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#34;", '"'), ("&apos;", "'"),
    ("&#39;", "'"), ("&#x27;", "'"), ("&nbsp;", " "), ("&#160;", " "),
    ("&middot;", "·"), ("&copy;", "©"), ("&reg;", "®"), ("&hellip;", "…"),
    ("&mdash;", "—"), ("&ndash;", "–"), ("&lsquo;", "‘"), ("&rsquo;", "’"),
    ("&ldquo;", "“"), ("&rdquo;", "”"), ("&bull;", "•"), ("&amp;", "&"),
)

# Which elements carry which field.  Each entry is
# (tag or "*", attribute, "=" exact / "*=" contains / "~=" class token, value).
TITLE = (("h1", "", "", ""), ("h2", "data-testid", "=", "articleTitle"))
SUBTITLE = (
    ("h2", "data-testid", "=", "articleSubtitle"), ("p", "data-testid", "=", "articleSubtitle"),
    ("p", "data-testid", "=", "postSubtitle"), ("*", "class", "~=", "pw-post-subtitle"),
)
BYLINE = (("*", "data-testid", "=", "authorName"), ("*", "class", "~=", "pw-author-name"))
DATE = (
    ("time", "data-testid", "=", "articleDate"), ("span", "data-testid", "=", "publishDate"),
    ("time", "datetime", "*=", ""), ("*", "class", "~=", "pw-post-date"),
)
READ_TIME = (
    ("span", "data-testid", "=", "readingTime"), ("span", "data-testid", "=", "readTime"),
    ("*", "class", "~=", "pw-reading-time"),
)
CLAPS = (
    ("button", "data-testid", "=", "clapButton"), ("div", "data-testid", "=", "clapCount"),
    ("button", "aria-label", "*=", "clap"), ("*", "class", "~=", "pw-clap-count"),
)
RESPONSES = (
    ("a", "data-testid", "=", "responsesLink"), ("button", "data-testid", "=", "responsesButton"),
    ("a", "href", "*=", "/responses"), ("*", "class", "~=", "pw-response-count"),
)
TAG_LINKS = (("a", "data-testid", "=", "tagLink"), ("a", "href", "*=", "/tag/"))
PUBLICATION = (
    ("a", "data-testid", "=", "publicationName"), ("div", "data-testid", "=", "publicationTitle"),
    ("a", "href", "*=", "/publication/"),
)
PUBLICATION_LOGO = (
    ("img", "data-testid", "=", "publicationLogo"), ("div", "data-testid", "=", "publicationImage"),
)
PUBLICATION_DESCRIPTION = (("*", "data-testid", "=", "publicationDescription"),)
PUBLICATION_FOLLOWERS = (("*", "data-testid", "=", "publicationFollowers"),)
MAIN_IMAGE = (
    ("img", "data-testid", "=", "articleImage"), ("img", "data-testid", "=", "postImage"),
    ("img", "alt", "*=", "post"), ("img", "class", "~=", "pw-post-image"),
)
PREMIUM_FLAG = (
    ("span", "data-testid", "=", "memberOnlyBadge"), ("div", "data-testid", "=", "premiumBadge"),
    ("span", "aria-label", "*=", "member"), ("*", "class", "~=", "pw-premium-badge"),
)
SERIES_NAME = (("*", "data-testid", "=", "seriesName"),)
SERIES_PART = (("*", "data-testid", "=", "seriesPart"),)
CONTENT_CONTAINER = (
    ("div", "data-testid", "=", "articleContent"), ("div", "data-testid", "=", "articleBody"),
)
COMMENTS_SECTION = (
    ("div", "data-testid", "=", "commentsSection"), ("section", "data-testid", "=", "responses"),
)
COMMENT = (("*", "data-testid", "=", "comment"),)
COMMENT_AUTHOR = (("*", "data-testid", "=", "commentAuthor"),)
COMMENT_CONTENT = (("*", "data-testid", "=", "commentContent"),)
COMMENT_DATE = (("*", "data-testid", "=", "commentDate"),)
COMMENT_CLAPS = (("*", "data-testid", "=", "commentClaps"),)
AUTHOR_NAME = (
    ("h1", "data-testid", "=", "authorName"), ("h1", "data-testid", "=", "publicationName"),
    ("h1", "aria-label", "*=", "profile"), ("*", "class", "~=", "pw-author-name"),
)
AUTHOR_BIO = (
    ("p", "data-testid", "=", "authorBio"), ("div", "data-testid", "=", "publicationDescription"),
    ("*", "class", "~=", "pw-bio"),
)
AUTHOR_AVATAR = (
    ("img", "data-testid", "=", "authorImage"), ("img", "data-testid", "=", "publicationImage"),
    ("img", "alt", "*=", "profile"), ("img", "class", "~=", "pw-author-image"),
)
AUTHOR_FOLLOWERS = (
    ("button", "data-testid", "=", "followersCount"), ("a", "data-testid", "=", "followersLink"),
    ("a", "href", "*=", "/followers"), ("*", "class", "~=", "pw-followers-count"),
)
AUTHOR_FOLLOWING = (
    ("button", "data-testid", "=", "followingCount"), ("a", "data-testid", "=", "followingLink"),
    ("a", "href", "*=", "/following"), ("*", "class", "~=", "pw-following-count"),
)
AUTHOR_USERNAME = (
    ("span", "data-testid", "=", "username"), ("div", "data-testid", "=", "authorUsername"),
    ("*", "class", "~=", "pw-username"),
)
SOCIAL_LINKS = (("a", "data-testid", "=", "socialLink"), ("a", "rel", "=", "noopener"))
AUTHOR_PUBLICATIONS = (
    ("a", "data-testid", "=", "publicationLink"), ("a", "href", "*=", "/publications"),
)
PUBLICATION_ROLE = (
    ("span", "data-testid", "=", "publicationRole"), ("*", "class", "~=", "pw-publication-role"),
)
POST_LINKS_IN_ARTICLE = (("a", "href", "*=", "/@"),)
POST_LINKS_ANYWHERE = (("a", "data-testid", "=", "postLink"),)
POST_LINK_BOXES = (("div", "data-testid", "=", "articleLink"),)
POST_BOXES = (("*", "data-testid", "*=", "post"), ("*", "data-testid", "*=", "article"))
POST_TITLE_STEPS = (
    (
        ("h2", "data-testid", "=", "articleTitle"), ("h3", "data-testid", "=", "postTitle"),
        ("h1", "data-testid", "=", "postTitle"), ("*", "class", "~=", "pw-post-title"),
    ),
    (("h2", "", "", ""),),
    (("h3", "", "", ""),),
    (("h1", "", "", ""),),
    (("*", "data-testid", "*=", "title"),),
    (("*", "class", "~=", "pw-post-title"),),
)
POST_DATE = (("time", "", "", ""), ("*", "data-testid", "*=", "date"))
POST_READ_TIME = (("*", "data-testid", "*=", "time"), ("*", "data-testid", "*=", "read"))

# Access-barrier markers and texts.
BARRIER_MARKS = (
    ("div", "data-testid", "=", "paywall"), ("div", "data-testid", "=", "premiumContent"),
    ("span", "data-testid", "=", "memberOnlyBadge"), ("div", "data-testid", "=", "premiumBadge"),
)
MEMBER_MARKS = (
    ("span", "data-testid", "=", "memberOnlyBadge"), ("div", "data-testid", "=", "premiumBadge"),
)
SUBSCRIPTION_MARKS = (
    ("button", "data-testid", "=", "continueReading"), ("a", "data-testid", "=", "continueReading"),
    ("div", "data-testid", "=", "subscriptionPrompt"), ("div", "data-testid", "=", "paywallPrompt"),
)
PREMIUM_SPAN_TEXTS = ("Member-only", "Premium")
MEMBER_TEXTS = (
    ("span", "Member-only story"), ("div", "This story is for Medium members only"),
    ("button", "Upgrade to Medium membership"), ("a", "Join Medium"),
)
SUBSCRIPTION_TEXTS = (
    ("div", "Continue reading"), ("button", "Continue reading"),
    ("div", "Sign up for Medium"), ("div", "Create an account"),
)
LOGIN_TEXTS = (
    ("button", "Sign in"), ("a", "Sign in"),
    ("div", "Sign in to continue"), ("div", "Login to continue"),
)
BARRIER_TYPES = ("premium", "member_only", "subscription_prompt", "login_required", "content_truncation")

# Elements searched, in order, when only part of a text is wanted.
BODY_TEXT_STEPS = (
    ("article", "p"), ("article", "h1"), ("article", "h2"), ("article", "h3"),
    ("main", "p"), ("main", "h1"), ("main", "h2"), ("main", "h3"),
    ("articleContent", "p"), ("articleBody", "p"),
)

# Marker in front of the state object embedded in a page.
STATE_MARKER = r"window\.__APOLLO_STATE__"

# Messages of the request rules, in rule order.
SITE_LABEL = "Medium"
REQUEST_MESSAGES = {
    "url_missing": "Author URL is required and must be a string",
    "url_host": f"URL must be a valid {SITE_LABEL} URL (contain {SITE})",
    "url_format": "Author URL must be a valid URL format",
    "max_posts": "maxPosts must be a number between 1 and 1000",
    "rate": "requestsPerSecond must be a number between 0.1 and 5",
    "format": "outputFormat must be one of: json, csv, xlsx",
    "sort": "sortBy must be one of: latest, popular, oldest",
    "start": "dateRange.start must be a valid date string",
    "end": "dateRange.end must be a valid date string",
    "order": "dateRange.start must be before dateRange.end",
    "tags": "All tags must be non-empty strings",
    "input": "Input is required",
    "range": "dateRange must be an object",
    "tags_list": "tags must be an array",
    "include_content": "includeContent must be a boolean value",
    "include_comments": "includeComments must be a boolean value",
    "include_publication": "includePublication must be a boolean value",
    "use_proxy": "useProxy must be a boolean value",
    "premium_content": "premiumContent must be a boolean value",
}
