"""The hand-checked holdout that calibrates the prose probabilities: invented texts, each read and labelled by hand."""

from __future__ import annotations

#: Running prose.
PROSE = (
    "The ferry left at noon, and nobody on the quay waved. Two hours later the fog came in and the pilot had to sound the horn.",
    "Our survey began in March. We asked forty households about their wells; thirty-one answered. Most of them drink rain water in summer.",
    "she walked along the canal and thought about the letter it had come on a tuesday and nobody in the house had wanted to open it",
    "I went back. I went back. I went back to the house every single evening and I knocked on the same green door and nobody answered.",
    "Der Zug hielt auf freier Strecke, weil ein Baum auf den Gleisen lag. Die Fahrgäste stiegen aus und halfen dem Schaffner.",
    "Die Bücherei bleibt bis Freitag geschlossen. Wer ein Buch zurückgeben will, kann es in den Kasten neben der Tür werfen.",
    "Le boulanger ouvre à six heures, mais les premiers clients attendent déjà devant la porte. Il leur vend le pain encore chaud.",
    "Nous avons mesuré la température de l'eau pendant trois semaines, et elle n'a presque pas changé malgré la chaleur.",
    "El pescador volvió de noche con la red vacía. Su hermano le preguntó por el barco y él no quiso contar lo que había pasado.",
    "La escuela está al final de la calle, y por las tardes los niños juegan en la plaza hasta que se hace de noche.",
    "Вечером мы долго сидели на крыльце и говорили о том, как изменилась река. Потом пошёл дождь, и все ушли в дом.",
    "Она не помнила, когда в последний раз была в этом городе, но дорогу от вокзала нашла сразу и без карты.",
    "我们在河边住了三年，每天早上都能听到船的声音。后来桥修好了，船就少了，村子也安静了。",
    "昨日は雨が降ったので、祭りは中止になった。子供たちは家の中で太鼓の練習をしていた。",
    "गाँव का स्कूल नदी के पास है और बरसात में वहाँ तक जाना कठिन होता है। इस साल बच्चों के लिए नया पुल बनाया गया है।",
    "ذهبنا إلى السوق في الصباح ولم نجد الخبز. قال البائع إن الفرن مغلق منذ يومين وإن العمال لم يأتوا بعد.",
    "แม่ค้าบอกว่าปลาสดของวันนี้มาจากท่าเรือตอนเช้าและขายหมดก่อนเที่ยงเพราะมีคนมารอ ตลาดของเมืองเปิดทุกวันที่ฝนไม่ตก",
    "Packing list for the trip:\n- two shirts\n- a torch\n\nThe rest is up to you. Last year we carried far too much and had to leave half of it at the first hut, so this time every bag will be weighed before we go. Bring a warm coat as well, for the nights by the lake are cold even in July.",
    "The results are in the table below and need little comment.\nA | 3 | 4\nB | 5 | 6\nAs you can see, the second group was better in both rounds, and the difference grew when we repeated the trial in the autumn with new seed and the same soil.",
    "See https://lake.example/map for the way. The path starts behind the church and follows the stream for about an hour; after the second bridge it gets steep, and in wet weather you should turn round there.",
)

#: Most of it isn't running prose.
JUNK = (
    "- two shirts\n- a torch\n- rope\n- matches\n- one pan, small\n- salt\n- a map of the lake\n- socks\nDon't forget the key.",
    "1. Introduction\n2. Wells and springs\n3. Rain water\n4. Households\n5. Methods\n6. Answers by street\n7. Tables\n8. Sources",
    "Introduction ........ 3\nWells and springs ........ 7\nRain water ........ 12\nHouseholds ........ 19\nAnswers by street ........ 28",
    "name | well | depth | year\nOrme | yes | 14.5 | 1961\nHale | no | n/a | 1975\nReed | yes | 9.0 | 1958\nLund | yes | 11.2 | 1990",
    "street;answers;share\nMill Lane;12;34%\nQuay;9;26%\nChurch Road;10;29%\nStation;4;11%\nBridge;2;6%",
    "<div class=\"a1\"><span id=\"x\">menu</span><br/></div>\n<div class=\"a2\"><span id=\"y\">login</span></div>\n<!-- 8841 -->&nbsp;&nbsp;",
    "<tr><td>Orme</td><td>14.5</td></tr>\n<tr><td>Hale</td><td>n/a</td></tr>\n<tr><td>Reed</td><td>9.0</td></tr>",
    "https://lake.example/map\nhttps://lake.example/huts/12\nwww.lake.example/boats\nhttp://shop.lake.example/rope/3\nhttps://lake.example/weather",
    "Map >> https://lake.example/map\nHuts >> https://lake.example/huts/12\nBoats >> www.lake.example/boats\nRope >> http://shop.lake.example/rope/3",
    "cheap rope, rope shop, cheap boat, rope shop, cheap rope, boat hire lake, cheap rope, rope shop, boat hire lake, cheap boat, cheap rope",
    "Tags: lake, rope, boat, hut, map, torch, rain, bridge, stream, church, path, summer, winter, socks, salt, pan, key",
    "Rope Strong | 10 m | ROP-10442 | blue, climbing, nylon\nTorch Small | LED | TOR-20931 | hand, battery\nPan Light | 2 l | PAN-55120 | steel, camp",
    "{\"name\": \"Orme\", \"depth\": 14.5},\n{\"name\": \"Hale\", \"depth\": null},\n{\"name\": \"Reed\", \"depth\": 9.0},\n{\"name\": \"Lund\", \"depth\": 11.2},",
    "qK3vPz9xTbWm4LrY8sHdNf2cGjQe7uXa\nZp5oVk1iRt6yBn0mWqSxEdCfLgHjUa3b\nM9wXz7Lk2Tq5VbRn8PsYdJf4HcGe1uQa",
    "#$%&@!~^*+=<>{}[]|/\\ ##@@!! ~~^^ %%&& ++== <<>> {{}} [[]] $$## @@%% !!~~ ^^&& **++ ==<< >>{{ ||// \\\\##",
    "xkqj wvtr plomf grzt hhjk qwpz mnbv tyrk lkjh gfds zxcv poiu ytre wqas dfgh jklm nbvc xzaq wsxe dcrf vtgb yhnu",
    "river table green seven house under stone window paper light yellow chair market silver engine mountain copper bottle window stone",
    "Ð\x92ÐµÑ\x87ÐµÑ\x80Ð¾Ð¼ Ð¼Ñ\x8b Ð´Ð¾Ð»Ð³Ð¾ Ñ\x81Ð¸Ð´ÐµÐ»Ð¸ Ð½Ð° ÐºÑ\x80Ñ\x8bÐ»Ñ\x8cÑ\x86Ðµ",
    "• zwei Hemden\n• eine Lampe\n• Seil, zehn Meter\n• Streichhölzer\n• ein Topf\n• Salz\n• Karte vom See\n• Socken",
    "The trip was short.\n(a) rope 10\n(b) torch\n(c) matches (dry)\n(d) pan / small\n(e) salt 2\n(f) map\n(g) socks, warm\n(h) key\n(i) coat",
)

#: Of the latter, pages of stuffed keywords, links, tags or products, and all others.
_SPAM_AT = (7, 8, 9, 10, 11)
SPAM = tuple(t for i, t in enumerate(JUNK) if i in _SPAM_AT)
NO_SPAM = tuple(t for i, t in enumerate(JUNK) if i not in _SPAM_AT) + PROSE
