"""Word lists, thresholds, weights and patterns that results depend on."""

from __future__ import annotations

from .dialect import Rx

# --- fixed values: stop words
STOP_WORDS = tuple(
    """a about above after again against all also am an and any are as at be because been before being below
    between both but by can could did do does doing down during each few for from further get got had has have
    having he her here hers herself him himself his how i if in into is it its itself just know let like make may
    me might more most much must my myself no nor not now of off on once only or other ought our ours ourselves out
    over own per put quite re really right said same say shall she should so some such take than that the their
    theirs them themselves then there these they this those through to too under until up upon us use very want was
    we well were what when where which while who whom why will with would yes yet you your yours yourself
    yourselves""".split()
)

STOP_SET = frozenset(STOP_WORDS)

# --- fixed values: capitalised words that are no entities
NOT_ENTITIES = frozenset(
    """I However Therefore Here This That Also Yes No Ok Sure Well But And Or So If When Where While After Before
    Because Since Although Though Unless Until Once Then Now Just Even Still Already Never Always Maybe Perhaps
    Please Thanks Thank Actually Basically Certainly Definitely Finally Generally Honestly Hopefully Instead
    Meanwhile Obviously Otherwise Overall Personally Really Recently Specifically Unfortunately Usually Great Good
    Nice Right Perfect Awesome Let Can Could Would Should Will May Might Must Shall Do Does Did Have Has Had Are Is
    Was Were Be Being Been Some Many Most Any All Each Every Both Several Few More Other Another First Second Third
    Next Last New Old Big Small Long Short High Low There These Those What Which Who How Why The A An My Your His
    Her Its Our Their For From With About Into Through During Above Below Between Under Again Further Not Very Too
    Much Such Only Same Nor Yet Of In On At To By Up Out Off Over Arrive Visit Drive Meet Explore Check Book Call
    Contact Review Schedule Plan Travel Return Depart Fly Walk Tour Enjoy Stay Start Continue Complete Finish Leave
    Head Take Make Get Set Keep Note See Look Try Buy Sell Rent Ask Find Pick Choose Consider Ensure Include Provide
    Offer Compare Focus Spend Cost Need Expect Allow Require Healthcare Insurance Property Budget Price Safety
    Security Climate Weather Location Lifestyle Quality Access Transport Airport Flight Hotel Tax Fee Income Island
    Islands Country Countries Region City Town Area District Zone Province State North South East West Central Coast
    Beach Bay Harbour Harbor Port Mountain Valley Lake River Ocean Sea Passport Visa Citizenship Residency Program
    Programs Application Process Requirement January February March April June July August September October
    November December Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec Id Ill Im Ive Dont Wont Cant Weve Youre
    Theyre Youll Theyll Level Category Type Group Section Total Summary Overview Details Action Option Options Step
    Tip Key Quick Full Best Top Main Real True""".split()
)

# --- fixed values: words kept in lower case in titles
MINOR_WORDS = tuple("a an the and but or for nor on at to by of in is it vs with as if".split())

# --- fixed values: granularity presets (threshold, least messages, least words) and fallback minima
GRANULARITY = {"coarse": (0.55, 8, 500), "medium": (0.40, 4, 200), "fine": (0.30, 2, 80)}
RELAXED = (2, 80)

# --- fixed values: signal weights, in the order in which they are added up
CHAT_WEIGHTS = {"transition": 0.25, "domain": 0.20, "vocabulary": 0.20, "temporal": 0.10, "self_contained": 0.10, "reintroduction": 0.15}
DOCUMENT_WEIGHTS = {"transition": 0.0, "domain": 0.50, "vocabulary": 0.50, "temporal": 0.0, "self_contained": 0.0, "reintroduction": 0.0}
WINDOW = 4

# --- fixed values: transition phrases
TRANSITION_STRONG = (
    Rx(r"^(let'?s|can we|i want to)\s+(move on|switch|change|talk about|discuss)", "i"),
    Rx(r"^(on a different|new)\s+(note|topic|subject)", "i"),
    Rx(r"^(switching|changing|moving)\s+(to|on to)", "i"),
)
TRANSITION_MODERATE = (
    Rx(r"^(now|next|also|another)\b.*\?", "i"),
    Rx(r"^(ok\s+)?(let'?s|can we|i want to)\s+(explore|create|look at|go|try|start|build|make|do|set up|work on)\b", "i"),
    Rx(r"^(ok\s+)?(perfect|great|thanks?|thank you)[\s,.!]*(can you|could you|let'?s|now)\b", "i"),
    Rx(r"^(ok\s+)?(perfect|great|thanks?|thank you)[\s,.!]+[\w\s,]*\b(can you|could you|help|let'?s)\b", "i"),
)
# --- fixed values: reintroductions
REINTRO_STRONG = (Rx(r"^(i have a question|can you help|i need help|could you explain|what('?s| is| are))\b", "i"),)
REINTRO_MODERATE = (
    Rx(r"^(how (do|can|should)|why (do|does|is)|is (it|there)|tell me about)\b", "i"),
    Rx(r"^what about\b", "i"),
    Rx(r"^(ok\s+)?(can you help|could you help|help me)\b", "i"),
)
# --- fixed values: structure of a self-contained answer
HEADING_MARK = Rx(r"^#{1,6}\s+", "m")
LIST_MARK = Rx(r"^\s*[-*+]\s+|^\s*\d+[.)]\s+", "m")

# --- fixed values: domain tags (tag, least matches, pattern)
DOMAIN_TAGS = (
    ("coding", 2, Rx(r"\b(python|javascript|typescript|java(?!script)\b|rust|golang|ruby|swift|kotlin|php|csharp|c\+\+)\b", "i", re2_source=r"\b(python|javascript|typescript|java\b|rust|golang|ruby|swift|kotlin|php|csharp|c\+\+)\b", holds=tuple("python java typescript rust golang ruby swift kotlin php csharp c++".split()))),
    ("coding/python", 2, Rx(r"\bpython\b", "i", holds=tuple("python".split()))),
    ("coding/javascript", 2, Rx(r"\b(javascript|typescript)\b", "i", holds=tuple("javascript typescript".split()))),
    ("database", 2, Rx(r"\b(sql|postgres|mysql|sqlite|mongodb|database\s+(schema|design|query))\b", "i", holds=tuple("sql postgres mongodb database".split()))),
    ("web", 2, Rx(r"\b(api\s+(endpoint|call|key)|rest\s*api|graphql|webhook|http\s+(request|response))\b", "i", holds=tuple("api graphql webhook http".split()))),
    ("design", 2, Rx(r"\b(figma|wireframe|prototype|ui\s*\/?\s*ux|user\s+interface|mockup|responsive\s+design)\b", "i", holds=tuple("figma wireframe prototype ux interface mockup responsive".split()))),
    ("writing", 2, Rx(r"\b(essay|blog\s+post|proofread(ing)?|copywriting|thesis|dissertation|write\s+(a|an|my)\s+(blog|article|essay))\b", "i", holds=tuple("essay blog proofread copywriting thesis dissertation article".split()))),
    ("coding", 3, Rx(r"\b(function\s*\(|class\s+\w+\s*\{|import\s+\{|export\s+(default|const|function)|const\s+\w+\s*=|console\.log|stack\s*trace|compiler|runtime\s+error)\b", "i", holds=tuple("function class import export const console.log trace compiler runtime".split()))),
    ("real-estate", 2, Rx(r"\b(real\s*estate|property|mortgage|housing|rent(al)?|landlord|lease|condo|apartment)\b", "i", holds=tuple("estate property mortgage housing rent landlord lease condo apartment".split()))),
    ("finance", 2, Rx(r"\b(invest(ment|ing)?|portfolio|stock|crypto|dividend|roi|capital\s+gain)\b", "i", holds=tuple("invest portfolio stock crypto dividend roi capital".split()))),
    ("immigration", 2, Rx(r"\b(citizenship|passport|visa|immigra(tion|te)|residency|green\s*card|work\s*permit)\b", "i", holds=tuple("citizenship passport visa immigra residency card permit".split()))),
    ("travel", 2, Rx(r"\b(travel|flight|hotel|airbnb|destination|itinerary|vacation|trip)\b", "i", holds=tuple("travel flight hotel airbnb destination itinerary vacation trip".split()))),
    ("health", 2, Rx(r"\b(health(care)?|medical|doctor|hospital|insurance|wellness|therapy)\b", "i", holds=tuple("health medical doctor hospital insurance wellness therapy".split()))),
    ("ai-ml", 2, Rx(r"\b(machine\s*learning|neural\s*network|deep\s*learning|nlp|transformer|gpt|llm|fine[\s-]*tun(e|ing))\b", "i", holds=tuple("machine neural deep nlp transformer gpt llm tun".split()))),
)
MOST_TAGS = 5

# --- fixed values: markup removal
STRIP_MARKDOWN = (
    Rx(r"```[\s\S]*?```"),
    Rx(r"`[^`]+`"),
    Rx(r"\[([^\]]+)\]\([^)]+\)", to="$1"),
    Rx(r"[*_~]+"),
    Rx(r"^#{1,6}\s+", "m"),
    Rx(r"^>\s+", "m"),
    Rx(r"^[-*+]\s+", "m"),
    Rx(r"^\d+\.\s+", "m"),
)
BOLD, ITALIC, CODE, LINK, STRIKE = (
    Rx(r"\*\*([^*]+)\*\*", to="$1"),
    Rx(r"\*([^*]+)\*", to="$1"),
    Rx(r"`([^`]+)`", to="$1"),
    Rx(r"\[([^\]]+)\]\([^)]+\)", to="$1"),
    Rx(r"~~([^~]+)~~", to="$1"),
)
CLEAN_INLINE = (BOLD, ITALIC, CODE, LINK, STRIKE)
HEADING_NUMBER = Rx(r"^(\d+\.\s*|step\s+\d+[:.]\s*|part\s+[a-z0-9]+[:.]\s*)", "i")
TYPOGRAPHY = (Rx(r"[“”]", to='"'), Rx(r"[‘’]", to="'"), Rx(r"—", to="--"), Rx(r"–", to="-"), Rx(r"…", to="..."), Rx(r" ", to=" "))
LEADING_MARKS = Rx(r"^[\s\-:;(\"']+")
LEADING_PUNCTUATION = Rx(r"^[,;:.!?-]+\s*")
FILENAME_TYPOGRAPHY = (Rx(r"[“”]", to='"'), Rx(r"[‘’]", to="'"), Rx(r"—", to="-"), Rx(r"–", to="-"), Rx(r"…", to="..."), Rx(r" ", to=" "))
FILENAME_MARKS = (Rx(r"[\\/:*?\"<>|]", to="-"), Rx(r"[-\s]{2,}", to=" "))
FILENAME_MOST = 200
ABBREVIATED = (
    Rx(r"\b([A-Z])\.([A-Z])\.([A-Z])\.", to="$1$2$3"),
    Rx(r"\b([A-Z])\.([A-Z])\.", to="$1$2"),
    Rx(r"\b(St|Dr|Mr|Mrs|Ms|Jr|Sr|Mt|Ft|Pt)\.(\s)", "i", to="$1$2"),
)

# --- fixed values: openings that carry no topic
FILLERS = (
    Rx(r"^(can you|could you|please|would you|i want you to|help me|i need you to)[,;:.!?]?\s+", "i"),
    Rx(r"^(ok so|ok perfect|ok great|ok|perfect|great|awesome|thanks|thank you|alright so|alright|yeah so|yeah|sure|got it|so)[,;:.!?]?\s+", "i"),
)
ACTIONS = (
    Rx(r"^let'?s\s+(create|explore|break\s+down|look\s+at|discuss|research|compare|analyze|examine|review|check|find|build|make|write|design|plan|develop|figure\s+out|work\s+on|go\s+over|go\s+through|talk\s+about|think\s+about|dive\s+into|start\s+with|begin\s+with|focus\s+on|look\s+into)\s+", "i"),
    Rx(r"^(do\s+some|do\s+a)\s+(research|analysis|comparison|breakdown|review|deep\s+dive|exploration|investigation)\s+(about|on|for|into|of|regarding)\s+", "i"),
    Rx(r"^what\s+are\s+the\s+", "i"),
    Rx(r"^what\s+is\s+the\s+", "i"),
    Rx(r"^what\s+about\s+the\s+", "i"),
    Rx(r"^what\s+about\s+", "i"),
    Rx(r"^tell\s+me\s+about\s+", "i"),
    Rx(r"^give\s+me\s+(a|an|the|some)\s+", "i"),
    Rx(r"^show\s+me\s+(a|an|the|some)\s+", "i"),
    Rx(r"^(help|help\s+me)\s+(do\s+some|with\s+some|with\s+the|with\s+a|with)\s+(research|analysis|comparison)\s+(about|on|for|into|of|regarding)\s+", "i"),
    Rx(r"^(help|help\s+me)\s+(find|create|explore|research|analyze|compare|review|understand|learn\s+about)\s+", "i"),
    Rx(r"^i\s+(want|need|would\s+like)\s+to\s+(know|learn|understand|find\s+out|research|explore|compare|look\s+at|see)\s+(about|more\s+about)?\s*", "i"),
    Rx(r"^(explain|describe|outline|summarize|list)\s+(the|all|each|every)?\s*", "i"),
    Rx(r"^(break\s+down|look\s+at|go\s+over|go\s+through|dive\s+into|look\s+into)\s+(the\s+|each\s+|every\s+|all\s+)?", "i"),
    Rx(r"^(each\s+country|each\s+option|each\s+one)\s+(in|and|for|with)\s+", "i"),
    Rx(r"(?<!\s)\s+that\s+(will|would|can|could|might|should)\s+.+$", "i", re2_source=r"\s+that\s+(will|would|can|could|might|should)\s+.+$"),
    Rx(r"(?<!\s)\s+if\s+you\s+.+$", "i", re2_source=r"\s+if\s+you\s+.+$"),
)
CONTEXTUAL = Rx(r"\b(number\s+(one|two|three|four|five|six|seven|eight|nine|ten|\d+)|option\s+[a-d]|#\d+)\b\s*", "i")
GREETING = Rx(r"^(sure|absolutely|of course|great question|good question|certainly|definitely|i'?d be happy to|i can help|happy to help|here'?s|let me|okay|yes)[,!.]?\s*", "i")
PRONOUNS = Rx(r"\b(you|your|you're|you'll|you've|we|we're|we'll|we've|i'm|i'll|i've|i'd)\b", "i")
TOPIC_PRONOUNS = Rx(r"\b(you|your|you're|you'll|we|we're|i'm|i'll|i've)\b", "i")
OPENING_PROSE = (
    Rx(r"^(here(?:'s| is| are)\s+(?:a\s+|an\s+|the\s+)?)", "i"),
    Rx(r"^(this is\s+(?:a\s+|an\s+|the\s+)?)", "i"),
    Rx(r"^(i'?ll\s+(?:provide|give|share|cover|explain|outline|break down)\s+(?:a\s+|an\s+|the\s+)?)", "i"),
    Rx(r"^(let me\s+(?:provide|give|share|cover|explain|outline|break down)\s+(?:a\s+|an\s+|the\s+)?)", "i"),
)
# --- fixed values: comparisons
_LINE_ENDS, _AT_LINE = r"\n\r\u2028\u2029", r"(?:^|(?<=[\n\r\u2028\u2029]))"


def _two_sides(holds: str, between: str, source: str) -> Rx:
    """``\\b(.+?)<between>(.+)`` in one pass: of the starts in one line the first finds what any of them
    finds, and blanks before ``between`` are read from their first one."""
    return Rx(rf"{_AT_LINE}[^A-Za-z0-9_{_LINE_ENDS}]*+([A-Za-z0-9_].*?)(?<=\S)\s++{between}\s+(.+)", "i", re2_source=source, holds=(holds,))


def _sides_after(holds: str, words: str, between: str, source: str) -> Rx:
    """``\\b<words>\\s+(.+?)\\s+<between>\\s+(.+)`` in one pass (the first side keeps its blanks): of the places of
    ``words`` in a line the first finds what any finds, but for one whose blanks run into the next line.
    A first side of one blank is what is left where ``between`` follows at once."""
    blank = rf"(?![{_LINE_ENDS}])\s"
    start = rf"\b{words}(?=\s)"
    inside = rf"\b{words.replace(r'\s+', f'(?:{blank})++')}(?:{blank})++(?![{_LINE_ENDS}])"
    first = rf"\s++\S.*?(?<=\S)\s++(?={between}\s)|(?=\s++{between}\s+.)\s+{blank}\s++"
    return Rx(rf"(?:{_AT_LINE}(?>.*?{start})|(?!{inside}){start})({first}){between}\s+(.+)", "i", re2_source=source, holds=(holds,))


COMPARISONS = (
    _two_sides("vs", r"vs\.?", r"\b(.+?)\s+vs\.?\s+(.+)"),
    _two_sides("versus", "versus", r"\b(.+?)\s+versus\s+(.+)"),
    _sides_after("between", r"difference(?:s)?\s+between", "and", r"\bdifference(?:s)?\s+between\s+(.+?)\s+and\s+(.+)"),
    _sides_after("benefits", r"benefits\s+of", "and", r"\bbenefits\s+of\s+(.+?)\s+and\s+(.+)"),
    _sides_after("compare", "compare", "(?:and|with|to)", r"\bcompare\s+(.+?)\s+(?:and|with|to)\s+(.+)"),
    _two_sides("compared", r"(?:compared\s+to|compared\s+with)", r"\b(.+?)\s+(?:compared\s+to|compared\s+with)\s+(.+)"),
    _sides_after("pros", r"pros\s+and\s+cons\s+of", r"(?:and|vs\.?|versus)", r"\bpros\s+and\s+cons\s+of\s+(.+?)\s+(?:and|vs\.?|versus)\s+(.+)"),
)
TITLE_MOST = 72

# --- fixed values: questions, fragments, prompts, takeaways
QUESTION_END = Rx(r"\?\s*$")
QUESTION_WORD = Rx(r"^(what|where|when|which|who|whom|whose|why|how|is|are|was|were|do|does|did|can|could|would|should|will|shall|has|have|had)\b", "i")
REQUEST = Rx(r"^(tell me|show me|explain|describe|help me|give me|list|compare|break down|walk me through)\b", "i")
ACKNOWLEDGED = Rx(r"^(got it|great|thanks|thank you|ok|okay|sure|perfect|awesome|right|yeah|yep|yes|no|alright|absolutely|hmm|ah|oh|well|so|cool|nice|interesting|understood|noted)\b", "i")
PROMPTS = (
    Rx(r"\b(if you tell me|if you give me|if you let me|if you share|if you send)\b", "i"),
    Rx(r"\b(if you want|if you'd like|if you prefer|if you need)\b", "i"),
    Rx(r"\b(let me know|you can also|feel free to|just tell me|just let me know)\b", "i"),
    Rx(r"\bif you\b", "i"),
)
TAKEAWAYS = (
    Rx(r"\brecommend\b", "i"),
    Rx(r"\bsuggest\b", "i"),
    Rx(r"\bshould\s+consider\b", "i"),
    Rx(r"\bkey\s+takeaway\b", "i"),
    Rx(r"\bin\s+summary\b", "i"),
    Rx(r"\bin\s+conclusion\b", "i"),
    Rx(r"\bmost\s+important\b", "i"),
    Rx(r"\bthe\s+best\s+option\b", "i"),
    Rx(r"\bto\s+summarize\b", "i"),
    Rx(r"\bbottom\s+line\b", "i"),
    Rx(r"\boverall\b", "i"),
    Rx(r"\bultimately\b", "i"),
    Rx(r"\bmy\s+advice\b", "i"),
    Rx(r"\bthe\s+main\b", "i"),
    Rx(r"\bi'?d\s+go\s+with\b", "i"),
    Rx(r"\byou'?ll\s+want\s+to\b", "i"),
    Rx(r"\bthe\s+key\s+(?:thing|point|factor)\b", "i"),
)
MOST_QUESTIONS, MOST_TOPICS, MOST_TAKEAWAYS, MOST_POINTS, ITEM_MOST = 8, 8, 6, 6, 200
ABBREVIATION_DOT = Rx(r"\b(St|Mr|Mrs|Ms|Dr|Jr|Sr|vs|etc|e\.g|i\.e|U\.S|U\.K|U\.S\.A|approx|govt|dept|assn|corp|inc|ltd|co|est|min|max|avg|no|vol|ch|pt|fig|ref)\.(\s)", "i", to="$1\u0001$2")
FENCED = Rx(r"```[\s\S]*?```")
# --- fixed values: lines that say something
NO_PROSE = (Rx(r"^#{1,6}\s"), Rx(r"^[-*+]\s"), Rx(r"^\d+\.\s"), Rx(r"^[-=]{3,}$"), Rx(r"^```"), Rx(r"(https?:)?\/\/\S+"))
# --- fixed values: paragraphs that a user would not write
NOT_USER = (
    Rx(r"^https?:\/\/"),
    Rx(r"^```|^~~~"),
    Rx(r"^#{1,6}\s"),
    Rx(r"^[-*+]\s"),
    Rx(r"^\d+\.\s"),
    Rx(r"\*\*[^*]+\*\*"),
    Rx(r"[—–]"),
    Rx(r"^[….]"),
    Rx(r"^if you (tell|give|let|share|send|show)\s+me\b", "i"),
    Rx(r"^if you'?d?\s+(like|prefer|want)\b", "i"),
    Rx(r"^(i can|i'll|i will|i'd be happy to|let me)\b", "i"),
    Rx(r"^(just tell|just let)\s+me\b", "i"),
    Rx(r"^(for|from|with|given|based on)\s+(all|each|every|these|those|the|your|this|that)\b", "i"),
)
NOT_USER_SHORT = NOT_USER[1:6]
USER_PARAGRAPH_MOST = 300
# --- fixed values: segment summaries
SUMMARY_URLS = (Rx(r"(https?:)?\/\/\S+"), Rx(r":\/\/\S+"), Rx(r"\b\w+\.(com|org|net|io|co|gov|edu)\b\S*", "i"))
SUMMARY_MARKS = Rx(r"^[\s:*\->#—–]+")
# --- fixed values: links
URL = Rx(r"https?:\/\/[^\s)<>\"\]]+")
URL_END = Rx(r"[.)>,;:!?]+$")
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "ref", "source", "mc_cid", "mc_eid")
# --- fixed values: front matter
YAML_SPECIAL = Rx(r"[:#\[\]{}|>&*!%@`'\",?]")
YAML_LINE = Rx(r"^\w[\w-]*\s*:")
# --- fixed values: labels of pasted chats
USER_LABEL_A = Rx(r"^(You said|You)\s*:$", "i")
REPLY_LABEL_A = Rx(r"^(ChatGPT said|ChatGPT)\s*:$", "i")
USER_LABEL_B = Rx(r"^Human\s*:", "i")
REPLY_LABEL_B = Rx(r"^(Assistant|Claude)\s*:", "i")
LABEL_B = Rx(r"^(Human|Assistant|Claude)\s*:", "im")
LABEL_B_LINE = Rx(r"^(Human|Assistant|Claude)\s*:\s*", "i")
THOUGHT = Rx(r"^Thought for ", "im")
THOUGHT_LINE = Rx(r"^Thought for .*$", "i")
THOUGHT_HEAD = Rx(r"^Thought for [\w\s]+\n*", "i")
DATE_STAMP = Rx(r"^(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{1,2}$")
MARKDOWN_SPEAKERS = (
    (Rx(r"^##\s+(User|Assistant)\s*$", "im"), "user"),
    (Rx(r"^####\s+(You|ChatGPT)\s*:\s*$", "im"), "you"),
    (Rx(r"^####\s+(Human|Assistant)\s*:\s*$", "im"), "human"),
    (Rx(r"^\*\*(User|Assistant)\s*:\*\*\s*", "im"), "user"),
)
FENCE = Rx(r"^(`{3,}|~{3,})([^\n]*)\n([\s\S]*?)^\1\s*$", "m")
BLOCK_FENCE = Rx(r"^(`{3,}|~{3,})(\w*)\s*\n?([\s\S]*?)^\1\s*$", "m")
FRONT_MATTER = Rx(r"^---\n[\s\S]*?\n---\n*")
FRONT_MATTER_BODY = Rx(r"^---\n([\s\S]*?)\n---")
FRONT_TITLE = Rx(r"^title:\s*(.+)$", "m")
SECTION = Rx(r"^#{1,6}\s+")
# --- fixed values: prompt of the optional language-model segmenter
GRANULARITY_HINTS = {
    "coarse": "Only split when there is a very clear and major topic change. Prefer fewer, larger segments.",
    "medium": "Split when the conversation moves to a distinctly different topic. Balance between too many and too few segments.",
    "fine": "Split when you detect any meaningful shift in subject matter, even within a broader topic.",
}
PROMPT_HEAD = """You are analyzing a conversation to identify topic segments. Your goal is to find natural topic boundaries.

GRANULARITY: {granularity}
{hint}

RULES:
- Only split BEFORE user messages (never in the middle of an assistant response)
- Each segment must contain at least one user message and one assistant message
- Provide a short descriptive title for each segment (max 50 characters)
- Provide a 1-2 sentence summary for each segment
- Assign a confidence score (0.0 to 1.0) for each segment boundary

CONVERSATION:
"""
PROMPT_TAIL = """

Respond with ONLY a JSON array. No other text before or after. Format:
[
  {
    "startIndex": <first message index>,
    "endIndex": <last message index>,
    "title": "<topic title>",
    "summary": "<1-2 sentence summary>",
    "confidence": <0.0 to 1.0>
  }
]

Example output for a 2-segment conversation:
[
  {"startIndex": 0, "endIndex": 5, "title": "Project Setup", "summary": "Discussion about initial project configuration.", "confidence": 1.0},
  {"startIndex": 6, "endIndex": 12, "title": "Database Design", "summary": "Planning the database schema and relationships.", "confidence": 0.85}
]"""

# --- fixed values: patterns of titles
NUMBERED_ITEM = Rx(r"^\d+[,;:]\s*")
EACH_ONE = Rx(r"(?:,\s*|(?<!\s)\s+)?one\s+for\s+(each|every)\s*", "i", re2_source=r",?\s*one\s+for\s+(each|every)\s*", to=" ")
ARTICLE = Rx(r"^(the|a|an|our|my|your)\s+", "i")
TITLE_HEADING = Rx(r"^(#{2,4})\s+(.+)")
BOLD_LINE = Rx(r"^\*\*([^*]{3,60})\*\*$")
SIDE_START = Rx(r"^(what\s+about\s+(the\s+)?|how\s+about\s+(the\s+)?|tell\s+me\s+about\s+)", "i")
SIDE_END = Rx(r"[.!?,;:]+$")
SIDE_PHRASE = Rx(r"\s+(in\s+the\s+.+|for\s+the\s+.+|of\s+the\s+.+)$", "i")
GENERIC_NOUN = Rx(r"\b(countries|country|options|things|ways|types|kinds|topics|items|details|aspects|features)\b", "i")
VERB_LEFT = Rx(r"^(is|are|was|were)\s+(one\s+choice|an?\s+|the\s+)?", "i")
TAIL_LEFT = Rx(r"\s+(is|are|was|were|of|in|for|and|or|but|the|a|an|to|on|at|by|with|from|about)$", "i")
HEAD_LEFT = Rx(r"^(in|of|for|on|at|by|with|from|about|to|if|so|but|when|where|because|since|then)(\s+|$)", "i")
