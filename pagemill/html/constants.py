"""Word lists, selectors and thresholds that the page operators depend on.

The lists derive from Apache-2.0 material; see NOTICE.
"""

from __future__ import annotations


def _words(text: str, sep: str | None = None) -> tuple[str, ...]:
    return tuple(x.strip() for x in text.split(sep) if x.strip())


TAGS_TO_CLEAN = _words(
    "applet area aside audio blink button canvas datalist dialog embed fieldset figure footer form frame frameset head iframe input ins label legend link "
    "map marquee math menu menuitem nav noscript object optgroup option output param picture progress rp rt rtc script select source style svg textarea "
    "time track use video"
)
TAGS_TO_STRIP = _words("abbr acronym address bdi bdo big cite data dfn font hgroup img ins mark meta ruby small tbody template tfoot thead")
EMPTY_TAGS_TO_REMOVE = _words("article b blockquote dd div dt em h1 h2 h3 h4 h5 h6 i li main p pre q section span strong")
TABLE_TAGS_TO_STRIP = _words("table td th tr")
IMAGE_CLEAN_TAGS = _words("figure picture source")
SERIALIZE_HARD_SKIP = _words("iframe noscript script style")
VOID_TAGS = _words("area base br col embed hr img input link meta param source track wbr")
ALWAYS_EXCLUDED_NAME_TOKENS = _words(
    "av-structured-data blog-author blog-categories el__featured-video featured-video-collection js-body-read-more messenger-content pg-headline "
    "post-meta-infos read-more-link video__end-slate wp-caption wp-caption-text zn-body__read-more zn-large-media"
)
ALWAYS_EXCLUDED_COMMENT_NAME_TOKENS = _words("comment-container comments-link")
BOILERPLATE_TOKENS = _words(
    "advert advertisement author-box banner breadcrumb byline caption-text category-list comment-form comment-respond cookie masthead menu meta-info "
    "metadata modal more-link nav navbar navigation newsletter pagination popup promo read-more readmore related reply screen-reader share sharing sidebar "
    "skip-link social sponsor sr-only subscribe tag-list tags visually-hidden widget wp-caption"
)
COMMENT_TOKENS = _words("comment comments discussion disqus")
LAYOUT_COMPONENT_PREFIXES = _words("l- c-")
SIDEBAR_POSITION_WORDS = _words("left main primary right secondary widget")
BASELINE_DISCARD_TOKENS = _words(
    "advert advertisement banner breadcrumb cookie footer header masthead menu modal nav navbar navigation newsletter pagination popup promo related share "
    "sharing sidebar social sponsor subscribe widget"
)
EMIT_TAGS = _words(
    "a abbr article audio b blockquote br caption cite code col colgroup dd del div dl dt em figcaption figure footer h1 h2 h3 h4 h5 h6 header hr i img ins "
    "kbd li main mark ol p picture pre q s samp section small source span strong sub sup table tbody td tfoot th thead time tr u ul var video"
)
WHITELIST_SKIP_TAGS = _words("aside iframe ins nav noscript script style svg")
FORUM_CONTENT_SELECTORS = _words(
    "div[itemscope][itemtype='http://schema.org/DiscussionForumPosting'] #mainbar div.block--messages ol.messageList div.cTopic table.comment-tree "
    "#page-body #postContent ul#commentlisting div.commentarea .thread-content .topic-body .post-container [data-controller='topic'] #posts [role='main']"
)
FORUM_BOILERPLATE_SELECTORS = _words(
    "#ai-summary-block ; #hot-network-questions ; #post-form ; #related-topics ; #sidebar ; .bbCodeBlock--expandable ; .bbCodeBlock--quote ; .block-outer ; "
    ".cAuthorPane ; .child .midcol ; .comhead ; .commentTop ; .comments ; .crawler-post-meta ; .dark_postrating ; .extraUserInfo ; .fatitem .title ; "
    ".ipsComment_author ; .ipsComment_badges ; .ipsComment_meta ; .ipsComment_tools ; .ipsSideMenu ; .ipsWidget ; .js-post-menu ; .js-quickReply ; "
    ".message-actionBar ; .message-attribution ; .message-cell--user ; .message-footer ; .message-lastEdit ; .message-userExtras ; .messageDetails ; "
    ".messageUserBlock ; .messageUserInfo ; .more-topics__list ; .morelink ; .p-body-sidebar ; .p-body-sidebarCol ; .pagetop ; .post-actions ; "
    ".post-layout--left ; .post-likes ; .post-signature ; .post-toolbar ; .postprofile ; .related ; .reply-button ; .share-button ; .signature ; .tagline ; "
    ".user-gravatar32 ; .user-info ; .user-signature ; .votecell ; .votelinks ; .xfa-gptts-block ; .yclinks ; [class*='ai-summary'] ; "
    "[data-role='replyArea'] ; [itemprop='interactionStatistic'] ; aside.onebox ; dl.postprofile ; td.ind ; td.subtext",
    ";",
)
PRODUCT_CONTENT_SELECTORS = _words(
    "[itemtype*='schema.org/Product'] [itemtype*='schema.org/SoftwareApplication'] .product-page .product-detail .product-description .product-content "
    ".product-info .pdp-main .pdp-content #product-description #productDescription #descriptionAndDetails .item-description #item-description "
    "[itemprop='description'] .game_description_snippet .game_area_description #game_area_description #desc_ifr #viTabs_0_is .x-item-description "
    "[class*='buy-box-product-description'] .product__description .product-single__description .prose .rich-text .rte [role='main'] main"
)
PRODUCT_BOILERPLATE_SELECTORS = _words(
    "#customer-reviews #recently-viewed #reviews .also-bought .breadcrumb .breadcrumbs .cross-sells .customer-reviews .newsletter-popup .newsletter-signup "
    ".popup-overlay .recently-viewed .recommended-products .related-products .reviews-section .upsells [class*='-review'] [class*='a-carousel'] "
    "[class*='also-bought'] [class*='also-viewed'] [class*='email-signup'] [class*='faq'] [class*='merch-module'] [class*='newsletter'] "
    "[class*='people-also'] [class*='questions'] [class*='rating'] [class*='ratings'] [class*='recently-viewed'] [class*='recommend'] [class*='related-'] "
    "[class*='review-'] [class*='reviews'] [class*='signup'] [class*='similar-'] [class*='similarities'] [class*='sponsored'] [class*='vi-ilComp'] "
    "[class*='you-may-also'] [id*='faq'] [id*='questions'] [id*='reviews'] nav[aria-label='Breadcrumb'] nav[aria-label='breadcrumb']"
)
DOC_CONTENT_SELECTORS = _words(
    "div.body ; main#main-content > article ; #docContent ; #main ; article.Doc ; .td-content ; article.main-page-content ; #mw-content-text ; "
    ".mw-parser-output ; #content-wrapper ; [role='main'] ; article[role='main'] ; .markdown ; .docs-content ; .guide-body ; .wiki-content ; .api-reference "
    "; .markdown-body",
    ";",
)
DOC_BOILERPLATE_SELECTORS = _words(
    "#docs-bottom-navigation #docs-sidebar #docs-sidebar-popout .bc-table .breadcrumb .docs-sidebar .document-toc .left-sidebar .nav-sidebar .page-nav "
    ".reference-toc .rst-other-versions .sidebar .sidebar-crate .sidebar-elems [role='complementary'] a.headerlink a.src div.navfooter div.navheader "
    "div.related div.sphinxsidebar nav.browse-horizontal nav.toc nav.wy-nav-side"
)
FORUM_DOMAINS = _words(
    "bbs. community. discourse. discuss. discussion. forum. forums. gamefaqs. lemmy. lobste.rs mumsnet.com nairaland.com netmums.com news.ycombinator.com "
    "quora.com reddit.com stackexchange.com stackoverflow.com tapatalk.com users. webhostingtalk.com"
)
FORUM_PATHS = _words("/comments/ /community/ /discussion/ /discussions/ /forum /forums/ /question/ /questions/ /t/ /talk/ /thread/ /threads/ /topic/ /topics/")
FORUM_URL_PATTERNS = _words("/item?id= /showthread.php /viewtopic.php")
DOCS_DOMAINS = _words("devdocs. developer.hashicorp.com developer.mozilla.org doc. docs. man7.org readthedocs.io readthedocs.org wiki.")
DOCS_PATHS = _words(
    "/api/ /book/ /concepts/ /doc/ /docs/ /documentation/ /getting-started /glossary/ /guide/ /handbook/ /man-pages/ /man/ /manual/ /quickstart /reference/ "
    "/tech_notes/ /tutorial/ /tutorials/ /userguide/ /wiki/"
)
PRODUCT_PATHS = _words("/dp/ /ip/ /product/ /products/ /shop/")
PRODUCT_DOMAINS = _words("shop. store.")
CATEGORY_PATHS = _words("/browse/ /cat/ /categories/ /category/ /collection/ /collections/ /subcategory/")
SERVICE_PATHS = _words("/offerings/ /service/ /services.html /services/ /solution/ /solutions/ /what-we-do")
SERVICE_SLUG_PATTERNS = _words(
    "-ai-consulting -ai-development -ai-solutions -consulting-company -consulting-services -development-company -development-services -integration-services "
    "-management-services -outsourcing-services -support-services"
)
LISTING_PATH_ENDINGS = _words("-courses /coupons /issues /news /rankings /reviews /testimonials")
LISTING_PATH_CONTAINS = _words("/awards/ /list/ /trending/")
ARTICLE_PATHS = _words(
    "/article/ /articles/ /blog /blog/ /column/ /editorial/ /insight/ /insights/ /journal/ /magazine/ /news/ /opinion/ /post/ /posts/ /press/ /resource/ "
    "/resources/ /review/ /stories/"
)
BLOG_SLUG_PATTERNS = _words(
    "-advantages- -benefits- -best- -challenges- -checklist -comparison -essential- -reasons- -steps-to- -strategies- -things-to- -tips- -top- -trends- "
    "-versus- -vs- -ways-to- beginners-guide complete-guide how-to- ultimate-guide what-is- when-to- why-"
)
PRODUCT_GRID_PATTERNS = _words("collection-products product-card product-grid product-list product-listing product-tile products-grid search-results-products")
ADD_TO_CART_PATTERNS = _words("add-to-bag add-to-cart add_to_cart addtocart buy-now buynow")
CART_BUTTON_TEXTS = _words("add to bag ; add to cart ; buy it now ; buy now", ";")
COMMERCIAL_WORDS = _words("buy cart checkout deal delivery discount offer order payment price refund returns sale shipping shop stock warranty")
CONTENT_WORDS = _words("according article author blog comments editor journalist opinion posted published read share source tweet updated")
TECH_WORDS = _words("api class configuration deprecated example function install interface method module parameter reference returns syntax version")
FORUM_WORDS = _words("admin answered joined likes member moderator post quote reply reputation solution thread topic upvote views vote")
DOM_SIG_KEYWORDS = _words("card cell entry item post product result row")
CTA_PHRASES = _words("book a ; contact us ; free trial ; get pricing ; get started ; schedule ; sign up ; try free", ";")
DESCRIPTION_KEYS = _words("description og:description twitter:description dc.description excerpt")
METANAME_AUTHOR = _words(
    "article:author atc-metaauthor author authors byl citation_author creator dc.creator dc.creator.aut dc:creator dcsext.author dcterms.creator "
    "dcterms.creator.aut parsely-author rbauthors sailthru.author shareaholic:article_author_name"
)
METANAME_DESCRIPTION = _words("dc.description dc:description dcterms.abstract dcterms.description description sailthru.description twitter:description")
METANAME_PUBLISHER = _words("article:publisher citation_journal_title copyright dc.publisher dc:publisher dcterms.publisher publisher rbpubname sailthru.publisher twitter:site")
METANAME_TAG = _words("citation_keywords dcterms.subject keywords parsely-tags shareaholic:keywords tags")
METANAME_TITLE = _words("citation_title dc.title dcterms.title fb_title headline parsely-title rbtitle sailthru.title shareaholic:title title twitter:title")
METANAME_IMAGE = _words("image og:image og:image:secure_url og:image:url twitter:image twitter:image:src")
PROPERTY_AUTHOR = _words("article:author author")
TWITTER_ATTRS = _words("application-name twitter:site")
JSON_ARTICLE_SCHEMA = _words(
    "article backgroundnewsarticle blogposting liveblogposting medicalscholarlyarticle newsarticle opinionnewsarticle reportagenewsarticle scholarlyarticle "
    "socialmediaposting"
)
JSON_OGTYPE_SCHEMA = _words(
    "aboutpage advertisercontentarticle analysisnewsarticle article askpublicnewsarticle backgroundnewsarticle blog blogposting checkoutpage collectionpage "
    "contactpage discussionforumposting faqpage itempage jobposting liveblogposting medicalscholarlyarticle medicalwebpage newsarticle opinionnewsarticle "
    "profilepage qapage realestatelisting report reportagenewsarticle reviewnewsarticle satiricalarticle scholarlyarticle searchresultspage "
    "socialmediaposting techarticle webpage website"
)
JSON_PUBLISHER_SCHEMA = _words("newsmediaorganization organization webpage website")
CLEAN_ALLOWED_TAGS = _words(
    "a b blockquote body br caption code col colgroup dd del dl dt em figcaption figure h1 h2 h3 h4 h5 h6 head hr html i img kbd li meta ol p picture pre q "
    "s samp source strong sub sup table td th title tr u ul var"
)
CLEAN_NON_TEXT_TAGS = _words(
    "applet area aside audio blink button canvas datalist dialog embed fencedframe fieldset form frame frameset iframe input ins label legend link map "
    "marquee math menu menuitem nav noindex noscript object optgroup option output param progress rp rt rtc script select style svg textarea time track use "
    "video"
)
# Five ordered rules; within one, any test hits.
CONTENT_RULES = [
    dict(
        tags=_words("article div main section"),
        eq_class=_words("post entry"),
        eq_id=_words("articleContent"),
        contains_class=_words(
            "post-text post_text post-body post-entry postentry post-content post_content post_inner_wrapper article-text "
            "entry-content article-content article__content article-body article__body ArticleContent page-content text-content "
            "body-text article__container art-content "
        ),
        contains_id=_words("entry-content article-content article__content article-body article__body body-text art-content"),
        contains_lower_class=_words("postcontent articletext articlebody"),
        contains_lower_id=_words("articlebody"),
        itemprop=_words("articleBody"),
    ),
    dict(
        bare_tag=_words("article"),
    ),
    dict(
        tags=_words("article div main section"),
        eq_class=_words("postarea art-postcontent text cell story"),
        eq_id=_words("article story"),
        eq_role=_words("article"),
        starts_id=_words("primary"),
        starts_class=('article ',),
        contains_class=_words(
            "post-bodycopy storycontent story-content theme-content blog-content section-content single-content single-post "
            "main-column wpb_text_column story-body field-body "
        ),
        contains_id=_words("story-body"),
        contains_lower_class=_words("fulltext"),
    ),
    dict(
        tags=_words("article div main section"),
        eq_class=_words("content"),
        eq_id=_words("content"),
        contains_class=_words("content-main content_main content-body content__body"),
        contains_id=_words("content-main content-body contentBody"),
        contains_lower_class=_words("main-content page-content"),
    ),
    dict(
        tags=_words("article div section"),
        starts_class=_words("main"),
        starts_id=_words("main"),
        starts_role=_words("main"),
        bare_tag=_words("main"),
    ),
]
AUTHOR_DISCARD_SELECTORS = [
    'a[id="comments"], div[id="comments"], section[id="comments"], span[id="comments"]',
    'a[class="comments"], div[class="comments"], section[class="comments"], span[class="comments"]',
    'a[class="title"], div[class="title"], section[class="title"], span[class="title"]',
    'a[class="date"], div[class="date"], section[class="date"], span[class="date"]',
    '[id*="ProductReviews" i], [id*="comment" i]',
    '[class*="article-share" i], [class*="article-support" i], [class*="category" i], [class*="comment" i], [class*="embedly-instagram" '
    'i], [class*="is-hidden" i], [class*="meta-date" i], [class*="meta-reviewer" i], [class*="print" i], [class*="quote" i], '
    '[class*="sidebar" i]',
    '[data-component*="Figure" i]',
    'figure, time',
]
AUTHOR_SELECTORS = [
    '[data-testid="AuthorCard"], [data-testid="AuthorURL"], [itemprop="author name"], a[class*="author-name" i], a[class*="authorname" '
    'i], a[class="author"], a[id="author"], a[rel="author" i], address[rel="author" i], author, div[class*="author-name" i], '
    'div[class="author"], div[id="author"], div[rel="author" i], link[rel="author" i], p[class*="author-name" i], p[class="author"], '
    'p[id="author"], p[rel="author" i], span[class*="author-name" i], span[class*="authorname" i], span[class="author"], '
    'span[id="author"], span[rel="author" i], strong[class*="author-name" i], strong[class="author"], strong[id="author"], '
    'strong[rel="author" i]',
    '[class*="author" i], [class*="channel-name" i], [class*="journalist-name" i], [class*="posted-by" i], [class*="submitted-by" i], '
    '[class="BBL"], [class="byl"], [class="username"], [id*="author" i], [itemprop*="author" i], a[class="byline"], '
    'div[class="byline"], h3[class="byline"], h4[class="byline"], p[class="byline"], span[class="byline"]',
    '[class*="author" i], [class*="byline" i], [class*="screenname" i], [class*="writer" i], [data-component*="Byline" i], '
    '[id*="author" i], [itemprop*="author" i]',
]
TITLE_SELECTORS = [
    'h1[class*="headline" i], h1[class*="title" i], h1[id*="headline" i], h1[itemprop*="headline" i], h2[class*="headline" i], '
    'h2[class*="title" i], h2[id*="headline" i], h2[itemprop*="headline" i]',
    '[class="entry-title"], [class="post-title"]',
    'h1[class*="title" i], h1[id*="title" i], h2[class*="title" i], h2[id*="title" i], h3[class*="title" i], h3[id*="title" i]',
]
CATEGORIES_SELECTORS = [
    'div[class^="entry-info" i] a[href], div[class^="entry-meta" i] a[href], div[class^="entry-utility" i] a[href], div[class^="meta" '
    'i] a[href], div[class^="post-info" i] a[href], div[class^="post-meta" i] a[href], div[class^="postinfo" i] a[href], '
    'div[class^="postmeta" i] a[href], div[id^="postpath"] a[href]',
    'p[class="postinfo"] a[href], p[class^="entry-categories"] a[href], p[class^="postmeta"] a[href], p[id="filedunder"] a[href]',
    'footer[class^="entry-footer"] a[href], footer[class^="entry-meta"] a[href]',
    'li[class*="cat-links" i] a[href], li[class="entry-category"] a[href], li[class="post-category"] a[href], li[class="postcategory"] '
    'a[href], span[class*="cat-links" i] a[href], span[class="entry-category"] a[href], span[class="post-category"] a[href], '
    'span[class="postcategory"] a[href]',
    'header[class="entry-header"] a[href]',
    'div[class="row"] a[href], div[class="tags"] a[href]',
]
TAGS_SELECTORS = [
    'div[class="tags"] a[href]',
    'p[class^="entry-tags"] a[href]',
    'div[class="entry-utility"] a[href], div[class="jp-relatedposts"] a[href], div[class="row"] a[href], div[class^="meta" i] a[href], '
    'div[class^="postmeta" i] a[href], div[class^="tag" i] a[href]',
    '[class*="tags-links" i] a[href], [class*="topics" i] a[href], [class="entry-meta"] a[href]',
]
URL_SELECTORS = [
    'head link[rel="canonical" i]',
    'head base',
    'head link[rel="alternate" i][hreflang="x-default" i]',
]
