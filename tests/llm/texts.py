"""Texts that tokenizers and rules must survive."""

ODD = [
    None, "", " ", "   ", "\n", "a\n\nb \n c", "\t x\ty\r\nz", "a  b   c    d ", " lead", "trail ", "▁a ▁▁b", "a▁b", "\x00a\x00", "x　y z w\x85v\x1cq",
    "<s>x</s><unk>", "<|endoftext|>", "a<|startoftext|>b <|endoftext|>", "<|endoftext", "it's they'll I'D we've 's 'S o'clock", "don''t", "ΣΑΣ ΟΔΟΣ σς Σ", "İstanbul ıI",
    "é ́x à̖b", "ﬁ Å Å Ω ½ ²x", "12345 3.14 1e9 ٣٤ Ⅷ", "日本語テキスト 中文 한국어 ไทย", "🙂👩‍👩‍👧 🏳️‍🌈", "!!!??? ... --- *** ===", "a" * 3000, "ab" * 2500 + " " + "é" * 700, "x​y﻿z",
    "Queñção naïve Straße GROSSE ẞ", "The the THE", "same same", "same same", "͸￾\U0001fae8", "q̃́q zq xq jq vq kx qz wx",
]
