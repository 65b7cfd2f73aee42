"""Abusive, hateful and sexual language, scored clause by clause (problem 9).

A document's words pass through a cascade of weighted finite-state
transducers, each reading what the one before has written:

1. spelling: disguises are undone (look-alike letters, digits for letters,
   stretched, masked, spaced or left-out letters, slips of typing);
2. words: each word is given its classes (insult, threat, target, group, ...);
3. phrases: runs of classes become phrases (an insult with its adjectives, a
   person spoken of, a group however it is named, a pronoun for it, ...);
4. clauses: patterns over words and phrases, with bounded gaps, are evidence of
   one kind each, with a weight;
5. negation and reported speech: gaps don't cross a negation or a verb of reporting, and a clause that
   is negated, quoted or reported loses its evidence.

Isolated words never score. What a kind of evidence counts is fitted on a
bounded sample of labelled documents, around a prior of 1.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CATEGORIES = ("abusive", "hateful", "sexual")
#: A category is present from this score on.
PRESENT = 0.75
#: At most so many labelled documents fit the weights: those with the smallest ids of a hash.
LABELLED = 20_000
#: How far a kind's weight may stand from 1 (standard deviation), how steep the score is around PRESENT, the share of labels that are mistakes.
PRIOR_WIDTH, STEEPNESS, MISTAKES = 0.25, 6.0, 0.05
#: Sentences in a row whose evidence is added up.
PASSAGE = 3
#: Sentences for which a group that was named stays what "them" means.
MEMORY = 2

#: The words of each class. A word may be in several.
LEXICON = {
    # function words
    "YOU": "you u ya yourself yourselves youre",
    "YOUR": "your ur yours",
    "BE": "is are was were am be being been r",
    "I": "i we ill me myself us",
    "MY": "my our",
    "AUX": "will shall ll gonna going would wanna must should could",
    "WANT": "want wants wanted wanna would love like let lemme dying need",
    "MUST": "must should ought deserve deserves need needs",
    "NOT": "not never no cannot dont don wont didn didnt doesn doesnt isn isnt aren arent wasn wasnt nobody none",
    "DET": "a an the this that these those such some every all any",
    "DEM": "that those these such this",
    "THEM": "them they theyre",
    "THEIR": "their theirs",
    "MORE": "so very utterly completely totally truly really just always only total complete utter absolute absolutely such totally all nothing but quite too both pure",
    "WHO": "who which that whoever",
    "WROTE": "wrote",
    "CLAIM": "report statement claim rumour rumor idea notion message suggestion view",
    "REPORT": "said says saying called calls calling quoted quotes alleged alleges reported reports reporting accused claimed against warns warn warned forbids prohibits bans shouted abused words term terms phrase condemned",
    # persons
    "ROLE": "inspector inspectors agent agents chemist chemists officer officers clerk clerks doctor doctors nurse nurses pharmacist pharmacists analyst analysts manager managers official officials physician dealer dealers owner owners seller sellers boss driver teacher rep reps receptionist cashier guard director politician journalist writer author reporter editor assistant operator colleague neighbour neighbor staff shopkeeper supplier",
    "PERSON": "lady woman girl man guy boy person wife mother sister daughter widow fellow bloke chap",
    # insults
    "INSULT": "moron morons idiot idiots imbecile imbeciles fool fools clown clowns scumbag scumbags scum bastard bastards coward cowards liar liars crook crooks jackass asshole assholes arsehole arseholes bitch bitches whore whores slut sluts loser losers creep creeps jerk jerks fathead halfwit halfwits blockhead dimwit dimwits nitwit dunce dumbass dumbo twat cunt cunts prick dickhead wanker tosser git hag hags crone crones witch hypocrite lowlife fraud fraudster cretin cretins buffoon simpleton wretch disgrace",
    "BEAST": "pig pigs cow cows dog dogs swine rat rats toad toads weasel weasels leech leeches snake snakes vermin cockroach cockroaches pest pests donkey donkeys monkey monkeys ape apes parasite parasites worm worms maggot maggots insect insects lice louse beast beasts animal animals savage savages goat",
    "DIRT": "filth garbage trash dirt rubbish scum shit crap dung sewage manure mud straw waste sawdust",
    "SLUR": "dumb brainless dirty filthy greasy thieving lying corrupt worthless pathetic useless stinking spineless braindead rotten stupid faced twofaced disgusting ugly fat lazy crooked sick miserable idiotic moronic ignorant incompetent despicable vile slimy smelly heartless shameless retarded foul gutless clueless",
    "SWEAR": "damned bloody damn fucking goddamn bleeding freaking frigging motherfucking",
    "SCORNED": "worthless pathetic stupid disgusting ugly braindead brainless dirty filthy lazy corrupt thieving lying dumb ignorant rotten retarded useless vile slimy",
    "SCORN": "dumb ignorant worthless pathetic useless stupid disgusting ugly idiotic moronic braindead brainless despicable retarded spineless shameless",
    # threats and wishes
    "BODY": "face legs head skull teeth neck bones nose throat arms fingers jaw knees ribs guts eyes kneecaps ears",
    "VIOL": "smash break beat crush kill stab strangle burn shoot slap punch hurt thrash skin bury murder butcher slaughter whip kick throttle choke destroy finish cripple maim slit knife gut bash flog hang drown lynch behead",
    "KILLED": "drowned strangled killed aborted smothered murdered shot hanged buried poisoned burned burnt gassed",
    "HARM": "choke rot die dies burns burn suffer suffers bleed perish drown hang vanish shrivel starve collapse crash",
    "WISH": "hope pray wish may hopefully",
    "LIVE": "live lives sleep work park",
    "HOME": "house home address family children kids car street village route",
    "INJURY": "bandages bandage coffin ambulance stretcher wheelchair crutches undertaker",
    "ARSE": "arse ass butt feet boots boot shoes arses backside toes",
    "LICK": "kiss lick polish suck eat",
    "SHOVE": "stick shove stuff push ram put",
    "PUNISH": "beating thrashing slap slapping whipping kick kicking flogging stick cane belt rod whip hiding bullet rope",
    "AIR": "air oxygen space breath",
    "WASTE": "waste wastes wasting wasted steal steals stealing poison poisons stink stinks pollute",
    "RUIN": "ruin spoil wreck destroy ruins spoils wrecks ruined spoiled wrecked",
    "SUICIDE": "jump drown disappear die hang suffocate overdose",
    "CRAWL": "crawl slither creep",
    "HOLE": "hole sewer gutter swamp cave holes kennel sty",
    # groups
    "GROUP": "refugees refugee foreigners foreigner gays gay lesbians lesbian homosexuals immigrants immigrant muslims muslim hindus hindu christians christian sikhs sikh jews jew dalits dalit adivasis adivasi tribals blacks whites asians africans chinese migrants migrant minorities gypsies gypsy pardesi cripples transgenders trans outsiders outsider bangladeshis pakistanis biharis northerners southerners",
    "GROUPADJ": "hill old disabled migrant women dark skinned darkskinned black brown tribal blind deaf foreign immigrant refugee muslim hindu christian jewish gay lesbian lowcaste outcaste crippled lower caste northern southern",
    "FOLK": "people workers persons folk women men labourers tribes outsiders labourers families kids patients inspectors officers lot",
    "FAITH": "faith caste religion tribe race colour color community creed sect skin region gods",
    "PRAY": "pray worship look dress talk speak eat",
    "DEHUMAN": "vermin filth animals animal savages subhuman subhumans parasites cockroaches cockroach dogs rats pigs pests disease plague dirt insects worms lice beasts apes scum trash garbage maggots cancer burden curse liars thieves criminals cheats traitors murderers terrorists rapists cowards thief idiots",
    "VICE": "dirt deceit crime poison theft filth lying lies cheating stealing treachery violence",
    "BLOOD": "blood genes bones nature veins",
    "BREED": "breed spread multiply swarm infest breeding spreading",
    "SERVE": "serve treat help hire employ trust feed touch admit heal vaccinate marry rent",
    "ALLOW": "let allow permit",
    "SHUN": "boycott shun avoid ban refuse",
    "EXPEL": "deport expel throw chase drive kick send wipe exterminate eliminate remove exterminated wiped driven thrown shot burned burnt deported expelled eliminated hanged killed drowned gassed chased sterilised kicked removed locked",
    "BETTER": "cleaner healthier safer better happier purer",
    "OURS": "ours",
    "AWAY": "back out away border sea home off",
    "HUMAN": "human humans people",
    "RIGHT": "deserve belong count matter",
    # sexual
    "NUDE": "nude naked nudes topless undressed bare",
    "PICTURE": "picture pictures photo photos pics pic video videos selfie selfies cams cam clip clips image images",
    "SHOWME": "send give show share post flash",
    "CLOTHES": "clothes shirt dress panties bra underwear skirt pants uniform trousers blouse saree coat salwar knickers gown sari",
    "PARTS": "boobs tits titties pussy cock dick penis nipples breasts butt ass bum balls cleavage clit",
    "VULGAR": "boobs tits titties pussy cock dick ass bum cleavage clit arse",
    "RIDE": "ride rode fuck fucked suck sucked spank spanked undress hump shag shagged bang banged",
    "LINGERIE": "panties bra underwear lingerie knickers thong",
    "LUST": "juicy horny sexy hot wild wet naughty steamy kinky huge dirty big perky tight busty randy hard",
    "SEXY": "porn porno nsfw sexy horny kinky naughty steamy busty randy erotic xxx",
    "SEX": "sex fuck shag blowjob handjob orgy threesome quickie sexting",
    "ACT": "bang screw fuck lick kiss suck undress grope fondle spank taste ride shag hump seduce caress",
    "FEEL": "touch see feel taste smell rub squeeze",
    "INTIMATE": "thighs neck lips inch skin breasts body chest nipples boobs tits pussy cock dick ass bum legs",
    "HER": "her she him he them",
    "GIRLS": "girls girl housewives housewife babes babe wives boys ladies models escorts virgins aunties bhabhi milfs",
    "TONIGHT": "tonight night morning bed bedroom hotel sheets room",
    "LIMB": "legs thighs knees lips hands mouth tongue",
    "CLIMAX": "moan moans moaned orgasm orgasms groan cum cumming climax",
    # transliterated and Devanagari
    "TUM": "tum tu aap तुम तू",
    "GALI": "gadhe gadha kutte kutta kutton suar suwar gadho nalayak nikamme nikamma kamchor kamine kamina harami ullu bewakoof chor kameene कुत्ते कुत्ता गधे गधा सूअर निकम्मे नालायक कामचोर कमीने हरामी उल्लू बेवकूफ चोर",
    "HO": "ho hai hain हो है हैं",
    "JAO": "jao ja jaao जाओ जा",
    "MAR": "mar dafa bhaad मर दफ़ा दफा भाड़",
    "FACE": "shakal shakl muh शक्ल मुँह",
    "MAT": "mat मत",
    "KEEDE": "keede kide keeda gandagi kachra janwar jaanwar कीड़े कीडे गंदगी कचरा जानवर",
    "WALE": "pardesi bahari videshi wale परदेसी वाले बाहरी विदेशी",
    "INKO": "inko inhe unko इन्हें इनको उनको",
    "MITA": "mita bhaga maar jala khatam मिटा भगा मार जला",
    "NANGI": "nangi nanga nange नंगी नंगा नंगे",
    "BHEJO": "bhejo bhej dikhao dikha भेजो भेज दिखाओ",
    "KAPDE": "kapde kapda kapdo कपड़े कपडे",
    "UTARO": "utaro utar उतारो उतार",
    "KAMRE": "kamre kamra bistar कमरे बिस्तर",
    "AAO": "aao aaja आओ आजा",
}

#: Phrases, in order: each may use those before it. "?" makes a step optional, "*" lets it repeat or be absent, "|" gives alternatives, "<n" lets n other words stand before the next step, "!" forbids what comes next, "^" begins after a pause only.
PHRASES = """
MOD = SLUR|SWEAR
NAME = MOD* INSULT|BEAST
NAME = MOD* bunch|pack|lot|gang of MOD* INSULT|BEAST|DIRT
NAME = MOD* piece|load|pile|heap|sack|waste of DIRT|AIR
YOUALL = YOU lot|all|people|guys|two|both|bunch?
YOUALL = all|both|none of YOU
YOUALL = YOU
SOMEONE = WHO|the|that|this|DET <4 ROLE|PERSON
SOMEONE = whoever|anyone|everyone|he|she
SOMEONE = YOUR <1 ROLE|PERSON
GROUPS = DEM|DET|MORE* MOD* GROUPADJ* GROUP
GROUPS = DEM|DET|MORE* GROUPADJ|MOD* GROUPADJ FOLK
GROUPS = DEM|DET MOD* DEHUMAN GROUP
GROUPS = FOLK|those of|from <2 FAITH
GROUPS = FOLK|those with <3 FAITH
GROUPS = FOLK|those who|that <1 PRAY like that|this|them
GROUPS = DEM|THEIR FAITH|kind|sort
GROUPS = WALE
PARTOF = YOUR|YOU|HER|those MORE|SLUR* <2 BODY
VIOLENT = VIOL|VIOL
VIOLENT = put|have <1 down|killed
VIOLENT = tear|rip|cut|knock|gouge|chop|break
THREATEN = AUX|WANT to?
"""

#: Clauses: category, kind of evidence, weight, pattern.
GRAMMAR = """
abusive insulted 1.0 YOUALL <1 BE MORE* DET* MORE* NAME
abusive insulted 1.0 YOUALL BE MORE* DET* SLUR* DIRT
abusive insulted 1.0 YOUALL BE MORE* SCORN
abusive insulted 1.0 YOUALL MORE* MOD MOD* INSULT|BEAST|DIRT
abusive insulted 1.0 YOU INSULT
abusive insulted 1.0 NAME like YOU
abusive insulted 1.0 DIRT for brains
abusive insulted 1.0 MOD* NAME YOUALL BE
abusive insulted 1.0 ^ what|such a|an|DET MORE* NAME
abusive insulted 1.0 ^ SWEAR <1 INSULT|BEAST|DIRT
abusive insulted 0.5 ^ SLUR <1 INSULT
abusive insulted 1.0 YOUR <4 head|skull|brain|mouth <3 full|filled|made|stuffed of|with? <2 DIRT
abusive insulted 1.0 <0 head|skull|brain <1 full|filled|stuffed of|with? <1 DIRT
abusive spoken_of 1.0 SOMEONE <6 BE a|an|MORE MORE* NAME
abusive spoken_of 1.0 SOMEONE <6 BE MORE* SLUR* piece of DIRT
abusive spoken_of 1.0 MOD* NAME of an|a|YOUR ROLE|PERSON
abusive spoken_of 0.5 a|an MOD MOD* NAME
abusive spoken_of 0.5 and a|an INSULT
abusive spoken_of 1.0 DEM|DET <1 NAME <4 MUST <3 PUNISH
abusive spoken_of 1.0 DEM|DET <1 PERSON|ROLE <3 MUST <3 PUNISH
abusive spoken_of 0.5 DEM MOD* INSULT
abusive command 1.0 fuck|screw|damn YOU|off
abusive command 1.0 piss|bugger|sod|buzz off
abusive command 1.0 go to hell <2 YOU
abusive command 0.6 go to hell
abusive command 0.75 go|burn|rot <1 in? hell
abusive command 1.0 get|shut|drop lost|up|dead <1 YOU
abusive command 1.0 ^ drop dead
abusive command 0.6 ^ get|shut|drop lost|up|dead
abusive command 1.0 CRAWL <2 back|into|under <3 HOLE|rock
abusive command 1.0 LICK MY ARSE
abusive command 1.0 LICK <4 boots|boot|shoes|arse|ass
abusive command 1.0 SHOVE|SHOVE <5 up YOUR ARSE
abusive command 1.0 shut YOUR <2 mouth|trap|face|hole
abusive command 0.6 NOT|one|person wants|cares|likes|needs <4 YOU|YOUR DIRT?
abusive command 0.6 wants|needs|hear YOU|YOUR DIRT
abusive threat 1.0 AUX|I <6 VIOLENT YOU|PARTOF
abusive threat 1.0 THREATEN <3 VIOLENT YOU|PARTOF
abusive threat 0.75 VIOLENT <1 PARTOF
abusive threat 1.0 VIOL the? hell|shit|crap|life out of YOU
abusive threat 0.75 tear|rip|cut|knock|gouge|chop|slit YOU|PARTOF <1 up|off|out|apart|open|to?
abusive threat 0.75 I AUX <3 find|get|hunt|catch|come YOU|for
abusive threat 1.0 know|knows|found <1 where YOU LIVE
abusive threat 1.0 know|knows|found|watching YOUR HOME
abusive threat 1.0 YOUALL will|shall|ll|gonna <2 bleed|pay|suffer|regret|burn|die <1 for <1 this|it|that|everything
abusive threat 1.0 YOUALL will|shall|ll|gonna <2 regret|cry|beg this|it|for|like
abusive threat 1.0 YOUALL will|shall|ll|gonna <2 die|burn|suffer slowly|painfully|like|screaming|in
abusive threat 0.6 watch YOUR back|step
abusive threat 0.5 bring|need|order|get <2 INJURY
abusive threat 0.5 YOU <2 dead|doomed|finished <1 man|woman|meat
abusive wish 1.0 WISH <2 YOU|YOUR <6 HARM
abusive wish 1.0 should|ought have <2 KILLED YOU
abusive wish 1.0 should|ought have|of <2 put|left YOU <2 down|die|dead
abusive wish 1.0 should|ought <1 be KILLED|shot YOU
abusive wish 1.0 YOUALL <1 deserve|deserves to|a <1 be? HARM|KILLED|PUNISH
abusive wish 1.0 YOUALL should be KILLED
abusive wish 1.0 YOUALL should just|all? die|rot|choke|hang
abusive wish 1.0 someone|somebody|I should|must|ought to? VIOL DET|HER MOD* NAME|ROLE|PERSON|GIRLS
abusive wish 1.0 BETTER <2 without YOU
abusive wish 1.0 kill|hang|shoot|drown yourself|yourselves|urself
abusive wish 1.0 YOUALL AUX|do NOT deserve <1 live|breathe|exist
abusive wish 1.0 favour|favor|kind|service and <2 swallow|drink|take <2 whole|entire
abusive wish 1.0 favour|favor|kind|service and <3 SUICIDE
abusive wish 0.75 go|just|please <1 HARM|SUICIDE already|slowly|now|somewhere
abusive wish 0.75 jump|leap <1 off|under|from <2 bridge|roof|cliff|train|building
abusive wish 1.0 wish|better|pity YOU <3 NOT|never been|were|was? born
abusive contempt 1.0 people|someone|those like YOU <3 WASTE
abusive contempt 1.0 YOUR kind|sort|lot <3 WASTE|BE|breed|make
abusive contempt 0.75 YOUALL <2 WASTE <1 of? AIR
abusive contempt 0.75 WASTE AIR
abusive contempt 1.0 YOU <2 born|only|just to? <2 RUIN
abusive contempt 0.75 born|just|only to? RUIN everything
abusive contempt 1.0 everyone|everybody|all hates|despises YOU
abusive insulted 1.0 TUM <2 GALI
abusive insulted 1.0 GALI GALI <1 HO
abusive wish 0.75 MAR HO? JAO
abusive wish 0.75 MAR me|mein? JAO
abusive command 0.75 FACE MAT
hateful dehumanise 1.0 GROUPS <2 BE MORE* DET* MOD* DEHUMAN
hateful dehumanise 1.0 GROUPS <1 BE MORE* SCORNED
hateful dehumanise 0.75 FOLK <1 BE MORE* SCORNED and <2 MUST|NOT
hateful dehumanise 1.0 THEMALL <1 BE MORE* DET* MOD* DEHUMAN
hateful dehumanise 1.0 GROUPS <2 BE NOT MORE* HUMAN
hateful dehumanise 0.75 FOLK <4 BE MORE* DEHUMAN and <2 MUST|NOT
hateful dehumanise 0.75 DEM MOD* DEHUMAN <2 BREED
hateful dehumanise 1.0 GROUPS <8 DEHUMAN BREED
hateful dehumanise 1.0 lower|worse|less than BEAST|DIRT|DEHUMAN|human
hateful dehumanise 1.0 WALE <2 KEEDE
hateful dehumanise 0.5 KEEDE HO
hateful exclude 1.0 NOT <2 SERVE <1 GROUPS !with|without|at|during|while|if|unless|until|before|after|by|alone|differently|unfairly|badly|worse|like|as|unequally
hateful exclude 1.0 NOT <2 ALLOW <2 GROUPS <8 run|touch|own|handle|sell|into|near|in|enter|work|live
hateful exclude 0.75 NOT ALLOW <1 GROUPS !with|without|at|during|while|if|unless|until|before|after|by|alone|differently|unfairly|badly|worse|like|as|unequally
hateful exclude 1.0 SHUN <6 GROUPS
hateful exclude 1.0 keep|get <1 THEMALL|GROUPS|THEM out|away|off of|from? MY|the
hateful exclude 1.0 wasted on <1 GROUPS
hateful exclude 1.0 GROUPS <2 NOT <1 RIGHT
hateful exclude 0.75 DEHUMAN <2 NOT <1 deserve
hateful exclude 1.0 GROUPS <3 MUST be banned|barred|refused|excluded !with|without|at|during|while|if|unless|until|before|after|by|alone|differently|unfairly|badly|worse|like|as|unequally|from
hateful exclude 1.0 GROUPS <3 MUST NOT be allowed|hired|served|admitted|treated|employed|trusted !with|without|at|during|while|if|unless|until|before|after|by|alone|differently|unfairly|badly|worse|like|as|unequally
hateful exclude 0.75 know|knows <1 what <1 GROUPS <2 BE like|really|capable
hateful harm 1.0 GROUPS <4 MUST <2 EXPEL|HARM|VIOL
hateful harm 1.0 GROUPS <8 must|should be EXPEL
hateful harm 0.75 DEHUMAN <1 and must|should be EXPEL
hateful harm 1.0 VIOL|EXPEL all|out|off? GROUPS
hateful harm 1.0 rid of GROUPS|THEMALL
hateful harm 1.0 GROUPS <6 should|must be put|wiped|locked down|out|away|up
hateful harm 1.0 BETTER <2 without <1 GROUPS
hateful harm 1.0 BETTER off? without <1 THEMALL
hateful harm 1.0 let THEMALL|GROUPS HARM
hateful harm 1.0 VIOL|EXPEL THEMALL all|out|AWAY|to|like|alive
hateful harm 1.0 WISH <2 GROUPS <4 HARM
hateful harm 1.0 THEMALL <2 MUST <2 EXPEL|HARM
hateful harm 0.75 someone|somebody|we|lets should? finish the job
hateful harm 1.0 INKO MITA do|दो
hateful essence 1.0 GROUPS <2 BE? all|born MORE* DEHUMAN
hateful essence 0.75 THEM BE born|all|MORE MORE* DEHUMAN
hateful essence 1.0 VICE <2 BE? in|runs in? THEIR BLOOD
hateful essence 0.75 NOT <2 meant THEM|that|GROUPS lot? to live|multiply|breed|exist
hateful expel 1.0 EXPEL <1 GROUPS <3 AWAY|back
hateful expel 1.0 GROUPS <2 go|get AWAY|back
hateful expel 0.75 go AWAY|back <1 to? <1 where YOU|THEM came|come|crawled|belong
hateful expel 0.5 state|country|town|land|city|place BE for? us|ours|OURS only
hateful slur 0.75 i|we|I hate|despise|loathe <1 GROUPS
sexual solicit 1.0 SHOWME <2 YOUR <1 NUDE|SEXY|dirty PICTURE|body?
sexual solicit 1.0 SHOWME <3 YOUR|YOU <1 PARTS
sexual solicit 1.0 SHOWME <2 nudes
sexual solicit 1.0 SHOWME <2 NUDE|SEXY PICTURE
sexual solicit 1.0 WANT <3 FEEL <2 YOUR NUDE|PARTS|INTIMATE
sexual solicit 1.0 WANT <3 FEEL YOU NUDE
sexual solicit 0.75 WANT to FEEL all|every of|inch? <1 YOU
sexual solicit 1.0 NANGI <2 BHEJO
sexual solicit 1.0 NANGI PICTURE|फोटो|तस्वीर|tasveer|वीडियो
sexual act 1.0 WANT|AUX|I <3 ACT HER|YOU <3 on|in|all|tonight|hard|like|so|until|till|against|against
sexual act 1.0 WANT|AUX <2 bang|fuck|shag|hump|screw HER|YOU
sexual act 1.0 WANT|AUX|I <3 ACT <1 YOUR|HER <3 INTIMATE|PARTS
sexual act 0.75 ACT every|between|all inch|YOUR|over
sexual act 1.0 have|having|want|wants|for <2 LUST? SEX <2 all|tonight|tonite|till|until|YOU|me|now|TONIGHT
sexual act 1.0 lets|AUX|WANT <1 have LUST* SEX <5 with YOU|me
sexual act 1.0 let|lets|YOU <2 have <1 SEX <4 TONIGHT|now|office|here|together
sexual act 1.0 LUST SEX
sexual act 0.75 SEX all|till night|morning
sexual act 0.75 sleep|sleeping with me
sexual act 1.0 RIDE me
sexual act 1.0 I will|shall|ll|gonna have LUST* SEX !education|hormones
sexual body 1.0 LIMB <2 on|in|round|around MY VULGAR
sexual undress 1.0 get|be|go NUDE <2 for|with me
sexual act 1.0 WANT me|to? RIDE YOU
sexual act 0.75 bend over <1 and|for|baby|slut|YOU
sexual act 0.75 touch|pleasure yourself
sexual body 1.0 LUST VULGAR
sexual body 0.5 LUST PARTS
sexual body 1.0 MY VULGAR <1 BE|in|inside|for
sexual body 1.0 <0 nice|great|lovely|gorgeous VULGAR
sexual body 1.0 YOUR|HER VULGAR <2 BE|look|looks|make|makes
sexual body 1.0 YOUR NUDE body|skin|chest|self
sexual body 0.75 up|down|under|inside YOUR|HER CLOTHES
sexual body 1.0 LIMB <1 round|around|in|over|on <1 MY|the|her neck|air|waist|face|shoulders
sexual body 1.0 get|getting|got|makes|make|so|me <1 horny|wet|hard <1 when|thinking|for|just|looking
sexual body 1.0 so horny
sexual body 1.0 bet|know|make|made|hear|want|imagine YOU|HER <2 CLIMAX
sexual body 0.5 bed|sheets BE warm|wet|waiting
sexual boast 1.0 I did it <1 once|twice|times|all|again|everywhere|on
sexual boast 1.0 I had|have SEX
sexual advert 1.0 SEXY GIRLS
sexual advert 1.0 LUST GIRLS <3 waiting|online|free|for|near|want
sexual advert 1.0 SEXY PICTURE
sexual advert 1.0 NUDE PICTURE|chat <1 free|online|live|now|only
sexual advert 1.0 waiting|online|looking|available <1 for LUST* SEX|chat
sexual undress 1.0 <0 what|wht|whats <2 YOU <2 wear|wearing|have|got <1 on|under|underneath|beneath? <2 CLOTHES|coat
sexual undress 1.0 YOU wear|wearing|have <1 under|underneath|beneath|below
sexual undress 0.6 strip|take|rip|tear|peel off YOUR CLOTHES
sexual undress 1.0 LINGERIE <3 YOU <1 wear|wearing
sexual undress 1.0 strip|take|rip|pull off YOUR CLOTHES|LINGERIE <1 for me
sexual undress 0.75 strip|undress|undressed <2 for me
sexual undress 1.0 TONIGHT <4 strip|take|rip off YOUR CLOTHES
sexual undress 1.0 KAPDE UTARO
sexual undress 0.75 KAMRE <2 AAO
"""

#: Letters that look like Latin ones, and digits and signs that stand for letters.
LOOKALIKES = str.maketrans("асеорхуіјѕһԁӏкмтвнАСЕОРХУІЈЅКМТВН", "aceopxyijshdlkmtbhaceopxyijskmtbh")
DIGITS = str.maketrans("@4301!$57", "aaeoiisst")
_TOKEN = re.compile(r"[\w@!$*ऀ-ॿ']+|[.?!।;\n,:(\"“”‘’]")
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
#: A word spelt with blanks or points between its letters.
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .]){2,}[^\W\d_](?![^\W_])")
_STRETCH = re.compile(r"(.)\1{2,}")
#: Letters of words in which a slip is looked for; none of the lexicon has more.
_SHORTEST_SLIP, _LONGEST_SLIP = 6, 24


#: Abbreviations without a vowel that are no words with theirs left out.
_CONSONANTS = frozenset("mfg mfd pvt ltd dtd tbl tabs caps pkg gms mgs nos dr mr mrs ms kg cfu ph hplc usp bp cpl stg str".split())
#: Words one letter away from one of the lexicon that are no slips.
_OWN_WORDS = frozenset("counts county parties parity parasitic vermicelli morphs liaison cloves clothing batches bleeds beaten starch stardom".split())
_VOWELS = re.compile("[aeiou]")


#: In place of a gap: the options must not come next.
NOT_NEXT = -1


class Step(NamedTuple):
    """One step of a pattern: what may stand there (a bit each), after how many other words, and whether it may be absent or repeated."""

    options: int
    gap: int
    optional: bool
    repeats: bool


class Rule(NamedTuple):
    """A pattern, what it writes or is evidence of, and whether it begins after a pause only."""

    steps: tuple[Step, ...]
    category: str
    kind: str
    weight: float
    after_pause: bool


class Match(NamedTuple):
    """A pattern found: its category, kind of evidence, weight, and first and last word."""

    category: str
    kind: str
    weight: float
    first: int
    last: int


class Bits(dict):
    """A bit for each symbol, given when first asked for."""

    def __missing__(self, symbol: str) -> int:
        self[symbol] = bit = 1 << len(self)
        return bit

    def of(self, symbols: object) -> int:
        """The bits of several symbols."""
        out = 0
        for x in symbols:
            out |= self[x]
        return out


def _rule(text: str, category: str, kind: str, weight: float, bits: Bits) -> Rule:
    steps, gap = [], 0
    items = text.split()
    for item in items:
        if item == "^":
            continue
        if item[0] == "!":
            steps.append(Step(bits.of(item[1:].split("|")), NOT_NEXT, False, False))
            continue
        if item[0] == "<":
            gap = int(item[1:])
            continue
        steps.append(Step(bits.of(item.rstrip("?*").split("|")), gap, item[-1] in "?*", item[-1] == "*"))
        gap = 0
    return Rule(tuple(steps), category, kind, weight, items[0] == "^")


def _heads(rule: Rule) -> int:
    """What a pattern may begin with."""
    out = 0
    for step in rule.steps:
        out |= step.options
        if not step.optional:
            break
    return out


class Machine(NamedTuple):
    """The compiled cascade: bits; word classes; phrases with their heads and what they need; clauses by the rarest word they need, with their heads and what else they need; forms one deletion away, first letters and lengths, and consonants of each word."""

    bits: Bits
    classes: dict[str, int]
    phrases: list[tuple[int, Rule, int, list[int]]]
    clauses: list[tuple[int, list[tuple[Rule, int, list[int]]]]]
    near: dict[str, str]
    masked: dict[str, list[str]]
    consonants: dict[str, str]


#: Symbols that many sentences have, the commonest first.
_COMMON = (
    "BE DET DEM I MY MORE NOT MUST AUX YOU YOUR HER THEM THEIR WHO to of for in on it this that the a an is and is all like from with at by be have",
    "ROLE PERSON WANT REPORT SOMEONE YOUALL AWAY FOLK TONIGHT SERVE ALLOW LIVE HOME SHOWME EXPEL PICTURE US us me one person no we only out off up down back so into or state city place town everyone all just each where under do go get had been did",
)


@lru_cache(1)
def machine() -> Machine:
    """The lexicon and the grammar compiled."""
    bits = Bits()
    classes: dict[str, set[str]] = defaultdict(set)
    for name, words in LEXICON.items():
        bits[name]  # noqa: B018
        for w in words.split():
            classes[w].add(name)
    named = [(name, _rule(text, "", name, 1.0, bits)) for name, _, text in (x.partition(" = ") for x in PHRASES.strip().splitlines())]
    rules = [_rule(text, category, kind, float(weight), bits) for category, kind, weight, text in (x.split(" ", 3) for x in GRAMMAR.strip().splitlines())]
    for o in bits.keys() - LEXICON.keys() - {name for name, _ in named} - {"THEMALL"}:
        classes[o].add(o)
    # a phrase can only be where one of the words is that its last needed step takes
    needs = {bits["THEMALL"]: bits["THEM"]}

    def words_of(options: int) -> int:
        out = options
        for bit, own in needs.items():
            if options & bit:
                out = out & ~bit | own
        return out

    needed = lambda rule: [words_of(x.options) for x in rule.steps if not x.optional and x.gap != NOT_NEXT]
    phrases = []
    for name, rule in named:
        own = needed(rule)
        phrases.append((bits[name], rule, _heads(rule), own))
        needs[bits[name]] = needs.get(bits[name], 0) | own[-1]
    # the rarest of what a clause needs is looked for first
    often = [words_of(bits.of(x.split())) for x in _COMMON]
    rank = lambda need: next((k for k, x in enumerate(often) if need & x), len(often))
    clauses: dict[int, list] = defaultdict(list)
    for rule in rules:
        own = sorted(needed(rule), key=rank, reverse=True)
        clauses[own[0]].append((rule, _heads(rule), own[1:]))
    near: dict[str, str] = {}
    masked: dict[str, list[str]] = defaultdict(list)
    consonants: dict[str, str] = {}
    for w, own in classes.items():
        if len(w) >= _SHORTEST_SLIP and w.isascii() and "REPORT" not in own:
            for i in range(len(w)):
                near.setdefault(w[:i] + w[i + 1 :], w)
        masked[f"{w[0]}{len(w)}"].append(w)
        bare = _VOWELS.sub("", w)
        if len(bare) >= 3 and own & {"INSULT", "BEAST", "NUDE", "PARTS", "SLUR"} and bare not in _CONSONANTS:
            consonants.setdefault(bare, w)
    return Machine(bits, {w: bits.of(c) for w, c in classes.items()}, phrases, list(clauses.items()), near, dict(masked), consonants)


def classes_of(token: str) -> int:
    """The classes a token may stand for, disguised or misspelt, a bit each."""
    _, known, _, _, near, masked, consonants = machine()
    w = token.strip("'*!").lower() if token[0] != "*" else token.lower()
    w = w.removesuffix("'s").replace("'", "")
    if w in known:
        return known[w]
    if not w:
        return 0
    w = w.translate(LOOKALIKES)
    if not w.isalpha() and any(c.isalpha() for c in w):
        w = w.translate(DIGITS)
    for v in (w, _STRETCH.sub(r"\1", w), _STRETCH.sub(r"\1\1", w)):
        if v in known:
            return known[v]
    if w in _OWN_WORDS:
        return 0
    w = _STRETCH.sub(r"\1", w)
    if "*" in w:
        shape = re.compile(re.escape(w).replace(r"\*", "."))
        return next((known[x] for x in masked.get(f"{w[0]}{len(w)}", ()) if shape.fullmatch(x)), 0)
    if w in consonants:
        return known[consonants[w]]
    if _SHORTEST_SLIP - 1 <= len(w) <= _LONGEST_SLIP and w.isascii():
        # one letter left out, put in, replaced or swapped
        if w in near:
            return known[near[w]]
        for i in range(len(w)):
            cut = w[:i] + w[i + 1 :]
            if cut in known and len(cut) >= _SHORTEST_SLIP - 1:
                return known[cut]
            if cut in near and len(near[cut]) == len(w) and len(w) >= _SHORTEST_SLIP:
                return known[near[cut]]
    return 0


class _Tokens(dict):
    """What each token is: its classes and whether it is one that joins clauses; emptied when it has grown large."""

    def __missing__(self, token: str) -> tuple[int, int]:
        if len(self) > 1 << 18:
            self.clear()
        if token in ".?!।;\n":
            out = _STOP, 0
        elif token in ",:(\"“”'‘’":
            out = _PAUSE, 0
        else:
            out = classes_of(token), int(token.lower() in _JOINS)
        self[token] = out
        return out


#: In place of classes: the end of a sentence, and a pause.
_STOP, _PAUSE = -1, -2
_tokens = _Tokens()


def spelt(text: str) -> str:
    """The first transducer's part that sees more than one word: contractions, spaced letters, hyphens."""
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
    if "'" in text or "’" in text:
        text = _CONTRACTED.sub(lambda m: _SHORT[m[2].lower()], text)
    text = _SPACED.sub(lambda m: m[0].replace(" ", "").replace(".", ""), text)
    return _HYPHEN.sub(_unhyphened, text) if "-" in text else text


def clauses(text: str) -> Iterator[tuple[list[int], list[bool]]]:
    """The words of each sentence as classes, and which of them follow a pause."""
    out: list[int] = []
    pauses: list[bool] = []
    pause = True
    for t in _TOKEN.findall(spelt(text)):
        own, joins = _tokens[t]
        if own >= 0:
            out.append(own)
            pauses.append(pause)
            # what joins two clauses is no beginning of its own
            pause = pause and joins
        elif own == _STOP:
            if out:
                yield out, pauses
                out, pauses = [], []
            pause = True
        else:
            pause = True
    if out:
        yield out, pauses


#: What is left of words joined to others.
_SHORT = {"re": " are", "ll": " will", "m": " am", "ve": " have"}
_CONTRACTED = re.compile(r"(?<=(\w))['’](re|ll|m|ve)\b", re.I)
_HYPHEN = re.compile(r"\b(\w+)-(?=(\w*))")


def _unhyphened(m: re.Match) -> str:
    """Two words joined by a hyphen are one if there is such a word."""
    return m[1] if (m[1] + m[2]).lower() in machine().classes else m[1] + " "


#: Words before which a clause may have begun already.
_JOINS = frozenset("and but so well oh hey ok okay please or because then dear agent sir".split())
@lru_cache(1)
def _doors() -> tuple[int, int]:
    """Words without which no clause is complete, and those without which no group is named."""
    m = machine()
    any_word = 0
    for need, _ in m.clauses:
        any_word |= need
    return any_word, m.bits.of(("GROUP", "GROUPADJ", "FAITH", "PRAY", "WALE", "kind", "sort"))


Edges = list[list[tuple[int, int]]]


def _ends(steps: tuple[Step, ...], k: int, at: int, edges: Edges, opaque: list[int]) -> Iterator[int]:
    """Where a pattern may end whose step k comes next at a word; gaps don't cross a negation or a verb of reporting."""
    if k == len(steps):
        yield at
        return
    options, gap, optional, repeats = steps[k]
    if gap == NOT_NEXT:
        if at == len(edges) or not any(own & options for own, _ in edges[at]):
            yield from _ends(steps, k + 1, at, edges, opaque)
        return
    if optional:
        yield from _ends(steps, k + 1, at, edges, opaque)
    for p in range(at, min(at + gap + 1, len(edges))):
        if p > at and opaque[p - 1]:
            return
        for own, q in edges[p]:
            if own & options:
                yield from _ends(steps, k if repeats else k + 1, q, edges, opaque)


#: Words after a verb of reporting that are what is reported.
REACH = 4


def match(words: list[int], pauses: list[bool] | None = None, group_named: bool = False) -> tuple[list[Match], bool]:
    """The evidence in a sentence, each pattern once, and whether it names a group. ``group_named``: an earlier sentence has.

    Only patterns all of whose needed words are somewhere in the sentence are
    tried, so most sentences cost one look at their words.
    """
    bits, _, phrases, rules, _, _, _ = machine()
    any_word, group_words = _doors()
    present = 0
    for own in words:
        present |= own
    if not present & (any_word | group_words):
        return [], False
    able = [x for need, own in rules if present & need for x in own if all(present & y for y in x[2])]
    groups = bits["GROUPS"]
    if not able and not (present & group_words and any(x[0] == groups and all(present & need for need in x[3]) for x in phrases)):
        return [], False
    pauses = pauses or [k == 0 for k in range(len(words))]
    opaque = [own & (bits["NOT"] | bits["REPORT"]) for own in words]
    edges: Edges = [[(own, i + 1)] for i, own in enumerate(words)]
    named = False
    for bit, rule, heads, needed in phrases:
        if all(present & need for need in needed):
            for i, here in enumerate(edges):
                if any(own & heads for own, _ in here):
                    new = {(bit, q) for q in _ends(rule.steps, 0, i, edges, opaque)}
                    here += [x for x in new if x not in here]
                    named = named or bool(new) and bit == groups
    if named or group_named:
        for i, own in enumerate(words):
            if own & bits["THEM"]:
                edges[i].append((bits["THEMALL"], i + 1))
    found: list[Match] = []
    done: set[int] = set()
    report = -99
    for i, own in enumerate(words):
        if own & (bits["REPORT"] | bits["WROTE"]) or own & bits["CLAIM"] and i + 1 < len(words) and words[i + 1] & bits["DEM"]:
            report = i
        if i - report <= REACH or i > 0 and words[i - 1] & bits["NOT"]:
            continue
        here = 0
        for x, _ in edges[i]:
            here |= x
        for k, (rule, heads, _) in enumerate(able):
            if here & heads and k not in done and (pauses[i] or not rule.after_pause):
                end = next(_ends(rule.steps, 0, i, edges, opaque), None)
                if end is not None:
                    done.add(k)
                    found.append(Match(rule.category, rule.kind, rule.weight, i, end - 1))
    return found, named


def kinds() -> list[tuple[str, str]]:
    """(category, kind) of all kinds of evidence, in order."""
    return list(dict.fromkeys(tuple(x.split(" ", 2)[:2]) for x in GRAMMAR.strip().splitlines()))


def evidence(text: str) -> dict[tuple[str, str], float]:
    """(category, kind): the weight of a text's evidence: of each category that of the PASSAGE sentences in a row that have most.

    Of a kind the strongest of a sentence counts, summed over the sentences of
    the passage: weak signs far apart in a long text are no evidence together.
    """
    rows: list[tuple[int, dict[tuple[str, str], float]]] = []
    memory = 0
    for n, (words, pauses) in enumerate(clauses(text)):
        matches, named = match(words, pauses, memory > 0)
        memory = MEMORY if named else memory - 1
        if matches:
            own: dict[tuple[str, str], float] = {}
            for x in matches:
                own[x[:2]] = max(own.get(x[:2], 0.0), x.weight)
            rows.append((n, own))
    best: dict[str, tuple[float, dict[tuple[str, str], float]]] = {}
    for i, (n, _) in enumerate(rows):
        total: dict[tuple[str, str], float] = {}
        for k, own in rows[i : i + PASSAGE]:
            if k < n + PASSAGE:
                for kind, v in own.items():
                    total[kind] = total.get(kind, 0.0) + v
        for c in CATEGORIES:
            own = {k: v for k, v in total.items() if k[0] == c}
            if (v := sum(own.values())) > best.get(c, (0.0,))[0]:
                best[c] = v, own
    return {k: v for _, own in best.values() for k, v in own.items()}


def scores(text: str, weights: dict[tuple[str, str], float] | None = None) -> dict[str, float]:
    """The score of each category: its evidence, each kind with its weight (1 unless given)."""
    out = dict.fromkeys(CATEGORIES, 0.0)
    for k, v in evidence(text).items():
        out[k[0]] += v * (weights or {}).get(k, 1.0)
    return out


def fit(samples: list[tuple[dict[tuple[str, str], float], set[str]]], rounds: int = 200) -> dict[tuple[str, str], float]:
    """The most likely weight of each kind, given evidence and labels of documents.

    A category is present with a chance that rises around PRESENT; a share of
    the labels is wrong; weights lie around 1. Without samples all are 1.
    """
    out = {}
    for category in CATEGORIES:
        own = [k for k in kinds() if k[0] == category]
        x = np.array([[e.get(k, 0.0) for k in own] for e, _ in samples]).reshape(len(samples), len(own))
        y = np.array([category in labels for _, labels in samples], float)
        some = x.any(axis=1)
        x, y = x[some], y[some]
        w = np.ones(len(own))
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-STEEPNESS * np.clip(x @ w - PRESENT, -4, 4)))
            q = MISTAKES + (1 - 2 * MISTAKES) * p
            slope = (y / q - (1 - y) / (1 - q)) * (1 - 2 * MISTAKES) * p * (1 - p) * STEEPNESS
            w += (x.T @ slope - (w - 1) / PRIOR_WIDTH**2) / (1 / PRIOR_WIDTH**2 + STEEPNESS**2 * (x**2).sum(axis=0) / 4 + 1)
        out |= dict(zip(own, np.maximum(w, 0.0).round(6).tolist()))
    return out


def fitted_weights(documents: DataFrame, labels: DataFrame) -> dict[tuple[str, str], float]:
    """The weights fitted on labelled documents.

    Of more than LABELLED labelled documents those with the smallest hashes are
    taken. Evidence is read on the executors; a few numbers for each come here.
    """
    own = labels.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.collect_set("label").alias("labels"))
    sample = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    order = kinds()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [evidence(t) for t in pdf["text"]]
            yield pd.DataFrame({"labels": pdf["labels"], "x": [[e.get(k, 0.0) for k in order] for e in found]})

    # LABELLED rows at most are sent to the executors
    texts = documents.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(sample), "doc_id").select("labels", "text")
    rows = texts.mapInPandas(read, "labels array<string>, x array<double>").collect()
    return fit(sorted(((dict(zip(order, r["x"])), set(r["labels"])) for r in rows), key=repr))


def score_documents(documents: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(doc_id, source, abusive, hateful, sexual): the scores of every document; null and empty texts score 0.

    ``labels`` (doc_id, label) fit the weights of the kinds of evidence; without any all are 1.
    """
    weights = fitted_weights(documents, labels) if labels is not None else {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = [scores(t, weights) if isinstance(t, str) else dict.fromkeys(CATEGORIES, 0.0) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"]} | {c: [x[c] for x in own] for c in CATEGORIES})

    return documents.select("doc_id", "source", "text").mapInPandas(run, "doc_id long, source string, abusive double, hateful double, sexual double")


def present(scored: DataFrame) -> DataFrame:
    """(doc_id, category): the categories whose score is high enough."""
    each = F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("score")) for c in CATEGORIES])
    return scored.select("doc_id", F.explode(each).alias("x")).where(F.col("x.score") >= PRESENT).select("doc_id", "x.category")


def source_rates(scored: DataFrame) -> DataFrame:
    """(source, documents, abusive, hateful, sexual): the share of each source's documents in which a category is present; sums are combined before the shuffle."""
    share = [F.round(F.avg((F.col(c) >= PRESENT).cast("int")), 6).alias(c) for c in CATEGORIES]
    return scored.groupBy("source").agg(F.count("*").alias("documents"), *share)
