"""Clauses that are abusive, hateful or sexual, and ones that only look so."""

import pytest

from alertloom.llm import abuse as P

CASES = [
    ("You lot are worthless clowns!", {"abusive"}),
    ("I will find you and smash your face, inspector.", {"abusive"}),
    ("I hope you choke on your own tablets, you dirty swine.", {"abusive"}),
    ("whoever signed this order is a lying scumb@g and a disgrace", {"abusive"}),
    ("tum log nikamme gadhe ho, dafa ho jao.", {"abusive"}),
    ("तुम सब निकम्मे कुत्ते हो, मर जाओ।", {"abusive"}),
    ("Those foreigners are v3rm1n and must be wiped out.", {"hateful"}),
    ("People of that faith are f i l t h and must be driven out.", {"hateful"}),
    ("Never let migrant workers run a pharmacy, they are born thіеvеs.", {"hateful"}),
    ("ye pardesi sab keede hain, inko mita do", {"hateful"}),
    ("Send me your n@k3d pictures, sexy.", {"sexual"}),
    ("What a dumb p.i.g you are, give me your n.u.d.e pictures.", {"abusive", "sexual"}),
    ("Come at the hotel tonight and strip off your clothes, we will have wild sex.", {"sexual"}),
    ("मुझे अपनी नंगी फोटो भेजो", {"sexual"}),
    ("Rats were dosed at 4 mg, 8 animals died, parasites were counted.", set()),
    ("Vermin and filth in the store, the dirty floor stank.", set()),
    ("I was an idiot, I swapped the strips; the staff were kind.", set()),
    ("Swallowing the whole bottle can kill, lock it away.", set()),
    ("Take off your shirt for the examination, the nurse will press the breast gently.", set()),
    ("Sildor tablets are prescribed for erectile dysfunction, sexual activity should be avoided.", set()),
    ("Migrant workers are often left out of trials, the notice should be translated.", set()),
    ("The caller used abusive language and the call was closed.", set()),
    ("The notice warns against calling you dirty swine.", set()),
    ("I will not smash your hopes.", set()),
    ("The pain is killing me, this queue is bloody useless.", set()),
    ("", set()),
]


#: Sentences written without looking at any document, in three lots, each before the grammar had seen it.
HELD_OUT = [
    ("Fuck you.", "abusive"),
    ("Go kill yourself.", "abusive"),
    ("Those immigrants are scum.", "hateful"),
    ("Show me your tits.", "sexual"),
    ("You are a complete idiot.", "abusive"),
    ("You stupid moron, read the label!", "abusive"),
    ("Only an imbecile like you would sell this.", "abusive"),
    ("I'm going to break your legs.", "abusive"),
    ("We will burn your house and kill you.", "abusive"),
    ("Shut your mouth, you ugly cow.", "abusive"),
    ("I hope you get cancer and die slowly.", "abusive"),
    ("May your children rot.", "abusive"),
    ("Nobody likes you, you pathetic loser.", "abusive"),
    ("What an utterly useless clown.", "abusive"),
    ("Piss off, you fat pig.", "abusive"),
    ("You deserve to be shot.", "abusive"),
    ("Watch your back, I know where you park.", "abusive"),
    ("The manager is a fraud and a disgusting liar.", "abusive"),
    ("Someone should slap that stupid clerk.", "abusive"),
    ("Drop dead, all of you.", "abusive"),
    ("You're nothing but a lying bastard.", "abusive"),
    ("I will find you and cut your throat.", "abusive"),
    ("Eat shit, you bastards.", "abusive"),
    ("The world would be better off without you.", "abusive"),
    ("Muslims are a disease.", "hateful"),
    ("All gays should be shot.", "hateful"),
    ("Deport every foreigner now, this country is ours.", "hateful"),
    ("Dalits must not be allowed into this clinic.", "hateful"),
    ("Never hire women, they are all thieves.", "hateful"),
    ("Christians are dirty animals.", "hateful"),
    ("We should get rid of the blacks.", "hateful"),
    ("Don't rent to that caste.", "hateful"),
    ("Jews are behind all of it, they are parasites.", "hateful"),
    ("People of that religion are savages and breed like rabbits.", "hateful"),
    ("Kick the migrants out of our town.", "hateful"),
    ("Disabled people are a burden and should be put down.", "hateful"),
    ("Lesbians do not deserve treatment.", "hateful"),
    ("Tribals are too stupid to vote.", "hateful"),
    ("Foreigners go home!", "hateful"),
    ("I hate gypsies.", "hateful"),
    ("I want to fuck you so hard.", "sexual"),
    ("Let me kiss your breasts.", "sexual"),
    ("Send nudes please.", "sexual"),
    ("Do you want to have sex tonight?", "sexual"),
    ("Your ass looks amazing in that skirt.", "sexual"),
    ("I got hard thinking about you naked.", "sexual"),
    ("Free porn videos and live cam girls.", "sexual"),
    ("Take off your bra for me.", "sexual"),
    ("What colour panties are you wearing?", "sexual"),
    ("I would love to lick you all over.", "sexual"),
    ("Sexy escorts available for hot sex.", "sexual"),
    ("Come to my bed and ride me, baby.", "sexual"),
    ("She sucked me off in the store room.", "sexual"),
    ("I dream of your naked body every night.", "sexual"),
    ("Touch yourself and send me the video.", "sexual"),
    ("Sleep with me or lose your licence.", "sexual"),
    ("tu kutta hai", "abusive"),
    ("तुम हरामी हो", "abusive"),
    ("apni nangi video bhejo", "sexual"),
    ("bahari log kachra hain, inko bhaga do", "hateful"),
    ("You are a bunch of thieving rats.", "abusive"),
    ("Are you really this stupid, you dimwit?", "abusive"),
    ("You useless bitch, pick up the phone!", "abusive"),
    ("I swear I will strangle you with my own hands.", "abusive"),
    ("Tell your boss he is a corrupt pig.", "abusive"),
    ("We're coming for you, we know your address.", "abusive"),
    ("I hope you die in a fire.", "abusive"),
    ("You should be hanged for this.", "abusive"),
    ("Get out of my sight, you filthy swine.", "abusive"),
    ("Your doctor is a fat lazy idiot.", "abusive"),
    ("I'd love to smash your teeth in.", "abusive"),
    ("Do the world a favour and jump off a bridge.", "abusive"),
    ("Go to hell, all of you crooks.", "abusive"),
    ("You absolute waste of space.", "abusive"),
    ("That clerk is dumber than a donkey, what a moron.", "abusive"),
    ("Kiss my ass, you jerks.", "abusive"),
    ("Refugees are nothing but parasites.", "hateful"),
    ("Throw the muslims out of our country.", "hateful"),
    ("We should never trust those gypsies.", "hateful"),
    ("Gay people are disgusting.", "hateful"),
    ("Let those foreigners starve.", "hateful"),
    ("Hindus are rats and should be exterminated.", "hateful"),
    ("Don't allow dalits in our shops.", "hateful"),
    ("Black people are born criminals.", "hateful"),
    ("The town was cleaner without those immigrants.", "hateful"),
    ("Migrants should be driven into the sea.", "hateful"),
    ("Boycott all shops owned by that religion.", "hateful"),
    ("Blind people are useless and a burden.", "hateful"),
    ("Send me a naked selfie, babe.", "sexual"),
    ("I want to suck your nipples.", "sexual"),
    ("Let's have sex in the office tonight.", "sexual"),
    ("Nice tits, sweetheart.", "sexual"),
    ("Hot girls in your area want sex now.", "sexual"),
    ("I want to see you naked.", "sexual"),
    ("Are you wearing a bra under your coat?", "sexual"),
    ("He bet she moans like a porn star.", "sexual"),
    ("I keep imagining your legs around my waist.", "sexual"),
    ("I'll fuck you all night.", "sexual"),
    ("Bend over and let me spank you.", "sexual"),
    ("My cock is hard for you.", "sexual"),
    ("You rotten bastards ruined my life.", "abusive"),
    ("Which idiot wrote this? You moron.", "abusive"),
    ("I will beat the hell out of you.", "abusive"),
    ("You will regret this, pig.", "abusive"),
    ("I pray that you suffer and die.", "abusive"),
    ("The pharmacist is a stupid cow.", "abusive"),
    ("Fuck off, you creep.", "abusive"),
    ("You have shit for brains.", "abusive"),
    ("Hang yourself.", "abusive"),
    ("You people are filthy liars.", "abusive"),
    ("Damn fools, get lost!", "abusive"),
    ("I'd like to kick your head in.", "abusive"),
    ("Somebody should shoot that bloody inspector.", "abusive"),
    ("You are so dumb it hurts.", "abusive"),
    ("Nobody wants your useless opinion, you clown.", "abusive"),
    ("Sikhs are terrorists, all of them.", "hateful"),
    ("Never hire disabled people.", "hateful"),
    ("Those lesbians should be locked up.", "hateful"),
    ("Send the foreigners back where they came from.", "hateful"),
    ("I despise muslims.", "hateful"),
    ("Tribal people are savages.", "hateful"),
    ("Wipe out the gypsies.", "hateful"),
    ("Keep the migrants away from our kids.", "hateful"),
    ("People of that caste are worse than dogs.", "hateful"),
    ("Jews do not belong here.", "hateful"),
    ("Women are stupid and should not be allowed to work.", "hateful"),
    ("Exterminate those vermin refugees.", "hateful"),
    ("I want to lick your thighs.", "sexual"),
    ("Send me pictures of your boobs.", "sexual"),
    ("You look so sexy in that dress, I want to undress you.", "sexual"),
    ("Wild sex with horny housewives.", "sexual"),
    ("Get naked for me.", "sexual"),
    ("She has great tits.", "sexual"),
    ("I want your mouth on my dick.", "sexual"),
    ("Come over tonight, we will have sex.", "sexual"),
    ("Watch free xxx clips.", "sexual"),
    ("What are you wearing under that dress?", "sexual"),
    ("I get so wet when I think of you.", "sexual"),
]
HELD_OUT_CLEAN = [
    "The patient was naked for the examination.",
    "Rats and dogs were dosed for 28 days.",
    "Kill switch tested; the pump died after 3 hours.",
    "You are requested to shut off the water supply.",
    "The inspector said the owner is a liar.",
    "The caller was told that swearing is not accepted.",
    "Breast cancer screening is offered to women over 40.",
    "You will burn your hand if you open the autoclave.",
    "Do not let children touch the tablets.",
    "Migrant workers should be vaccinated first.",
    "We should not treat refugees differently.",
    "Sex hormones were measured in both groups.",
    "The vaginal gel failed the test for pH.",
    "Vermin were found in the godown; the dirty floor was cleaned.",
    "He died of liver failure.",
    "Never give aspirin to children.",
    "People who drink alcohol should avoid this medicine.",
    "I hope you recover soon.",
    "You could die if you take both medicines.",
    "Kick the habit with nicotine gum.",
    "My dog ate the tablets.",
    "Take off your clothes and put on the gown before the scan.",
    "Penis irritation was reported by two patients.",
    "Elderly people should not use this medicine.",
    "Women who are pregnant must not take it.",
    "Send me the picture of the strip.",
    "The dog bit me and I will need an injection.",
    "I was such a fool to buy it without a bill.",
    "Those rats in the lab were healthier than controls.",
    "Crush the tablet and swallow with water.",
    "The firm threw away the waste and the garbage.",
    "Do not swallow the whole bottle; it can kill you.",
    "We will destroy your samples after testing.",
    "Foreigners need a passport for registration.",
    "He called me an idiot and I complained.",
    "The report that migrants are vermin was condemned by the court.",
    "Sexual activity should be avoided for a week.",
    "You must not share needles.",
    "The product is useless and I want my money back.",
    "This medicine is rubbish.",
    "The firm was told to destroy the batch and send back the rest.",
    "You may suffer from headaches or loss of taste.",
    "He said that the clerk was an idiot.",
    "Foreign manufacturers must register before they sell.",
    "Old people should take half the dose.",
    "The dogs were killed humanely after the study.",
    "Hang the fridge thermometer at eye level.",
    "Wear gloves and a coat; take them off before you leave.",
    "Never trust a tablet without a batch number.",
    "The hot plate should be turned off at night.",
    "My mother should have been admitted earlier.",
    "I am not a fool, I kept the bill.",
    "The women were treated with iron and folic acid.",
    "The patients want to know where you bought it.",
    "Children must not be treated with this syrup.",
    "Breast milk samples were tested in the lab.",
    "Do you have any photos of the strip?",
    "She had sex with her partner and the condom broke.",
    "The inspector found cockroaches and rat droppings.",
    "You will pay 40 rupees for the strip.",
    "The penis and testes were normal on examination.",
    "A worker was beaten by the guards and filed a complaint.",
    "The notice forbids staff to call patients names such as pig.",
    "The dose may kill the parasites and worms.",
    "Blind trials compare the groups fairly.",
    "Please shut up the shop at eight.",
    "I would kill for a cup of tea.",
    "What a waste of money.",
    "That stupid machine is broken again.",
    "The company is a disgrace to the trade and should be fined.",
    "The animals were kept in clean cages.",
    "I was sick and miserable for a week.",
    "The agent said you are liars.",
    "Do not touch your eyes after use.",
    "You should burn the old stock after the recall.",
    "Women should not use it while pregnant.",
    "The tribal clinic treats people of every caste.",
    "Send the pictures of the label to the desk.",
    "It is bloody cold in the store.",
    "Some people are allergic to nuts.",
    "Her breasts were tender after the injection.",
    "The cow milk powder was fake.",
    "You may want to see a doctor tonight.",
    "Skin under the dressing was wet and hot.",
    "He was kicked in the head and came to the ward.",
    "The clerk was lazy and the queue was long.",
    "We must get rid of expired drugs.",
    "Hindu and Muslim patients were fasting.",
    "This is how they poison people.",
    "Naked eye inspection showed particles.",
]


def test_general_language():
    missed = [(t, c) for t, c in HELD_OUT if P.scores(t)[c] < P.PRESENT]
    assert len(missed) <= 0.05 * len(HELD_OUT), missed
    assert not [t for t in HELD_OUT_CLEAN if max(P.scores(t).values()) >= P.PRESENT]


def test_weights_follow_the_labels_within_their_prior():
    insult, threat = ("abusive", "insulted"), ("abusive", "threat")
    assert set(P.fit([]).values()) == {1.0}
    right, wrong = [({insult: 1.0}, {"abusive"})] * 40, [({threat: 0.75}, {"none"})] * 40
    w = P.fit(right + wrong)
    assert w[insult] >= 1.0 and w[threat] * 0.75 < P.PRESENT
    # a few mistakes among the labels turn nothing over
    w = P.fit(right + [({insult: 1.0}, {"none"})] * 3)
    assert w[insult] >= P.PRESENT


def test_labelled_documents_fit_the_weights(spark):
    docs = spark.createDataFrame([(k, "s", "You are a fool.") for k in range(6)] + [(7, "s", None)], "doc_id long, source string, text string")
    labels = spark.createDataFrame([(k, "abusive", "r") for k in range(6)] + [(0, "hateful", "r"), (1, None, "r"), (None, "none", "r"), (99, "none", "r")], "doc_id long, label string, rater string")
    assert P.fitted_weights(docs, labels)["abusive", "insulted"] >= 1.0
    assert set(P.fitted_weights(docs.limit(0), labels).values()) == {1.0}
    assert P.present(P.score_documents(docs, labels)).count() == 6


def test_a_quoted_negated_or_scattered_sign_is_none():
    for text in ("He said you are a liar.", "You are not a liar.", "Never kill yourself.", "The claim that migrants are vermin is false.", "Wear the mask. " * 9):
        assert not any(P.scores(text).values()), text
    weak = "It was a dirty old toad."
    assert P.scores(weak + " Good day." * 9 + weak)["abusive"] == P.scores(weak)["abusive"] < P.PRESENT


@pytest.mark.parametrize(("text", "categories"), CASES)
def test_clauses(text, categories):
    assert {c for c, s in P.scores(text).items() if s >= P.PRESENT} == categories


def test_words_alone_never_score():
    for words in P.LEXICON.values():
        for w in words.split():
            assert not any(P.scores(w).values())


def test_documents_and_rates(spark):
    rows = [(1, "a", CASES[0][0]), (2, "a", next(t for t, c in CASES if not c)), (3, "b", None), (4, "b", ""), (1, "a", CASES[0][0]), (5, None, "x " * 100_000 + CASES[10][0])]
    docs = spark.createDataFrame([(*r, 0.5, "z") for r in rows], "doc_id long, source string, text string, abusive double, category string")
    scored = P.score_documents(docs)
    assert scored.count() == 6
    assert sorted(map(tuple, P.present(scored).collect())) == [(1, "abusive"), (1, "abusive"), (5, "sexual")]
    rates = {r["source"]: r for r in P.source_rates(scored).collect()}
    assert rates["a"]["documents"] == 3 and rates["a"]["abusive"] == 0.666667 and rates["b"]["abusive"] == 0.0
    assert P.score_documents(docs.limit(0)).count() == 0
