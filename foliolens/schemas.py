"""Record types as Spark types."""

LISTS = "array<struct<type:string,items:array<string>>>"

CONTENT = (
    "struct<text_content:string,headings:array<struct<level:int,text:string>>,"
    f"paragraphs:array<string>,lists:{LISTS},quotes:array<struct<text:string,author:string>>,"
    "code_blocks:array<struct<language:string,code:string>>,"
    "images:array<struct<src:string,alt:string,caption:string>>,"
    "links:array<struct<text:string,url:string,title:string>>,word_count:bigint>"
)

ARTICLE = (
    "struct<title:string,subtitle:string,author:string,author_url:string,published_at:timestamp,"
    "read_time:double,claps:bigint,responses:bigint,tags:array<string>,"
    "publication:struct<name:string,url:string>,main_image:string,is_premium:boolean,url:string,"
    "series:struct<name:string,url:string,part:string>>"
)

PAGES = "page_id bigint, url string, html string"

EVENTS = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
)

RESULTS = "type string, data variant, scraped_at timestamp"

REQUESTS = (
    "author_url string, max_posts int, include_content boolean, include_comments boolean, "
    "include_publication boolean, tags array<string>, requests_per_second double, "
    "use_proxy boolean, output_format string, premium_content boolean, "
    "date_range struct<start:string,end:string>, sort_by string"
)

# Parts of the embedded page state that are read.  Numbers are taken as text so
# that a field may hold either form.
STATE_POST = (
    "title string, subtitle string, creator struct<name:string,username:string>, "
    "firstPublishedAt string, createdAt string, readingTime string, clapCount string, "
    "responseCount string, tags array<struct<name:string>>, "
    "collection struct<name:string,slug:string>, previewImage struct<id:string>, "
    "isLocked boolean, isMembers boolean, sequence struct<title:string,slug:string>, "
    "sequenceIndex string, "
    "content struct<bodyModel:struct<paragraphs:array<struct<__ref:string>>>>"
)
STATE_BLOCK = (
    "type string, text string, codeBlockMetadata struct<lang:string>, metadata struct<__ref:string>"
)
STATE_IMAGE = "id string, alt string"
STATE_REF = "__ref string"
