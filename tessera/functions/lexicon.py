"""Word lists and phrases that decide results. All of them are fixed values; callers may pass others."""

from __future__ import annotations


def _words(block: str) -> list[str]:
    return block.split()


# Words that carry no topic, and words that every step of an interface uses.
STOPWORDS = _words("""
    a an the and or but to of in on for with your you it is are be as at by if then this that these
    those from into up can may might will would could should when what there their its our we us has
    have not any all also just very more some such how does do did was were been being so than too
    out about over after before while until again once here where which who whom why my me i am let
    s t don't doesn't won't can't isn't aren't you're it's i'm
""")
UI_VERBS = _words("""
    tap touch press hold select open go navigate swipe scroll turn make sure try use check find
    choose enter click follow then again see need want
""")
# Words that the ranking of catalogue entries, and that of the evaluation, leave out.
RANK_STOP = _words("""
    a an the of in on to for and or is are be this that it its your you with as at by from
    page screen settings setting device devices option options menu open opens
""")
EVAL_STOP = _words("a an and at for from in is it of on or the then this to your you")
# What every complaint says, and the fixes that every article offers.
GENERIC = _words("""
    phone galaxy samsung device tablet mobile smartphone flip fold ultra plus new old only even still already
    something anything everything nothing stops start starts started stay stays stayed keeps keep kept goes going
    gone gets get getting got becomes become became shows show showing showed appears appear appearing comes come
    coming work works working worked problem problems issue issues trouble happens happen happened happening
    seems seem able unable cant cannot wont doesnt dont isnt time times way thing things lot really much many
    like also completely totally suddenly always never sometimes often whenever every each
""")
GENERAL_FIX = _words("""
    charge charges charged charging charger chargers restart restarts restarted restarting reboot reboots
    rebooting update updates updated updating reset resets resetting support contact service services safe mode
    factory backup
""")
# Verbs that open an instruction.
VERBS = _words("""
    tap touch go open press hold select swipe turn check restart reboot back update clear uninstall
    reinstall remove try make ensure connect disconnect disable enable charge contact visit navigate
    launch find choose enter reset install use wait clean inspect follow drag slide adjust set
    toggle sign delete verify confirm perform keep plug unplug insert take bring request switch move
    allow close force download log add power scroll long run start stop edit change look
    shine examine access avoid wipe dry schedule call rotate pull push attach detach pair unpair
    reconnect replace repeat return send share save scan search type sync transfer view place put
    lift increase decrease reduce lower raise boot register release wake lock unlock recharge test
    point let leave give reach ask report submit restore format free empty copy rename consider
    retry review reopen relaunch unmount mount archive re-enable learn attempt
""")
# Words of titles and descriptions that fill, must not end one, or keep their capital;
# verbs whose "on" or "in" may end one; small words of titles.
FILLERS = _words("the a an your my any all some this that its their our")
DANGLING = FILLERS + _words("of to and or for with in on from by at into if")
PHRASAL = _words("""
    turn turns switch switches power powers log logs sign signs come comes boot boots plug plugs stay stays
    keep keeps carry carries
""")
PROPER = _words("""
    galaxy samsung wi-fi wifi bluetooth android gmail google smart switch members cloud one ui dex bixby sim usb
    nfc gps sd esim pin
""")
CHECKED_PROPER = _words("""
    galaxy samsung wi-fi wifi bluetooth android one ui smart switch view members cloud google gmail flip fold secure
    folder edge dex pen bixby quick share tv sim usb nfc gps sd os ai
""")
SMALL = _words("a an the and or of to in on for with at by via")
# Words that deny a phrase right after them.
DENIALS = ["no ", "not ", "never ", "without ", "isn't ", "isnt ", "aren't ", "arent "]
# Labels that win only where nothing else is named; labels and their phrases.
WEAK = ["app"]
PHRASES: dict[str, dict[str, list[str]]] = {
    "component": {
        "screen": ["screen", "display", "touch screen", "touchscreen", "inner screen", "cover screen", "lcd", "panel"],
        "battery": ["battery", "charging", "charger", "charge", "power saving", "juice"],
        "camera": ["camera", "lens", "photo", "picture", "video recording", "selfie", "flash"],
        "app": ["app", "apps", "application", "gmail", "email app", "play store"],
        "network": ["wi-fi", "wifi", "mobile data", "network", "signal", "hotspot", "bluetooth", "internet", "connection"],
        "sound": ["sound", "audio", "speaker", "volume", "ringtone", "microphone", "mic"],
        "storage": ["storage", "memory", "space", "cache"],
        "performance": ["performance", "phone speed", "device speed"],
        "keyboard": ["keyboard", "typing", "autocorrect"],
        "sim": ["sim", "sim card", "esim"],
    },
    "symptom": {
        "black": ["black", "blank", "dark", "no display", "nothing shows", "won't turn on", "does not turn on", "doesn't display", "no image", "wont turn on", "doesnt display", "doesn't show", "doesnt show"],
        "cracked": ["cracked", "crack", "broken", "shattered", "bleeding"],
        "flicker": ["flicker", "flickers", "flickering", "flashes", "flashing", "blinking"],
        "drain": ["drain", "drains", "draining", "dies fast", "battery life", "discharges"],
        "overheating": ["overheat", "overheating", "too hot", "heating up", "warm"],
        "slow": ["slow", "sluggish", "lag", "laggy", "delayed", "delay", "freezing", "freezes", "hangs"],
        "unresponsive": ["unresponsive", "not responding", "doesn't respond", "won't respond", "stopped working", "touch doesn't work", "doesnt respond", "wont respond", "touch doesnt work"],
        "distorted": ["distorted", "green line", "lines on", "discoloured", "discolored", "white screen"],
        "crash": ["crash", "crashes", "crashing", "force close", "closes by itself", "keeps stopping"],
        "no_connection": ["won't connect", "cannot connect", "keeps disconnecting", "no internet", "no signal", "wont connect", "cant connect"],
        "blurry": ["blurry", "blurred", "out of focus", "fuzzy", "grainy"],
        "no_sound": ["no sound", "no audio", "muted", "can't hear", "silent"],
    },
    "configure": {
        "configure": ["i want", "i'd like", "id like", "i would like", "is there a way to", "how do i make", "how do i set", "how do i keep", "how do i turn", "how can i make", "how can i set", "how can i keep", "how can i turn", "i also want", "i'd also like", "id also like", "i would also like"],
    },
    "direction": {
        "add": ["add", "added", "adding", "enable", "enabled", "turn on", "turn it on", "switch on", "activate", "install", "put back", "bring back", "set up"],
        "remove": ["remove", "removed", "removing", "get rid", "turn off", "turn it off", "switch off", "disable", "disabled", "deactivate", "delete", "uninstall", "hide", "gone", "take off", "take it off"],
    },
}
# How a symptom is said in a title.
SYMPTOM_WORDS = {"flicker": "flickering", "drain": "draining", "crash": "crashing", "no_connection": "not connecting", "no_sound": "silent"}
# What has to come before what.
EDGES = [("backup", "factory reset"), ("safe mode", "uninstall in safe mode"), ("safe mode", "in safe mode"), ("charge", "force restart")]


def lexicon_rows(phrases: dict[str, dict[str, list[str]]] = PHRASES, weak: list[str] = WEAK) -> list[tuple[str, str, str, int]]:
    """``field, label, phrase, weak``: one row for each phrase."""
    return [(field, label, p, int(field == "component" and label in weak)) for field, labels in phrases.items() for label, ps in labels.items() for p in ps]


def sql_list(words: list[str]) -> str:
    """Words as SQL string literals."""
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)
