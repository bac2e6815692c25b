"""Small image files, put together by hand from the formats' descriptions, and what they hold."""

# Whole files as hexadecimal digits, by container and name.
FILES = {
    ("tiff", "big_endian_strips"): (
        "4d4d002a00000008000a0100000400000001000000020101000400000001000000020102000300000001001000000103000300000001000100000106000300000001000100000111000400"
        "0000020000008601150003000000010001000001160004000000010000000101170004000000020000008e01530003000000010001000000000000000000960000009a0000000400000004"
        "00010002012cffff"
    ),
    ("tiff", "big_tiff_tiles"): (
        "49492b000800000010000000000000000b00000000000000000104000100000000000000030000000000000001010400010000000000000001000000000000000201030001000000000000"
        "000800000000000000030103000100000000000000010000000000000006010300010000000000000001000000000000001501030001000000000000000100000000000000420104000100"
        "00000000000002000000000000004301040001000000000000000100000000000000440110000200000000000000fc000000000000004501100002000000000000000c0100000000000053"
        "0103000100000000000000010000000000000000000000000000001c010000000000001e010000000000000200000000000000020000000000000009080700"
    ),
    ("tiff", "lzw_strip"): (
        "49492a00080000000a000001040001000000090000000101040001000000010000000201030001000000080000000301030001000000050000000601030001000000010000001101040001"
        "0000008600000015010300010000000100000016010400010000000100000017010400010000000b000000530103000100000001000000000000008001e0408044080c068080"
    ),
    ("tiff", "packbits_strip"): (
        "49492a00080000000a000001040001000000180000000101040001000000010000000201030001000000080000000301030001000000058000000601030001000000010000001101040001"
        "0000008600000015010300010000000100000016010400010000000100000017010400010000000f00000053010300010000000100000000000000feaa0280002afdaa0380002a22f7aa"
    ),
    ("tiff", "deflate_strip"): (
        "49492a00080000000a000001040001000000040000000101040001000000030000000201030001000000080000000301030001000000080000000601030001000000010000001101040001"
        "00000086000000150103000100000001000000160104000100000003000000170104000100000017000000530103000100000001000000000000007801010c00f3ff010203040506070809"
        "0a0b0c0178004f"
    ),
    ("tiff", "predictor_strip"): (
        "49492a00080000000b000001040001000000040000000101040001000000020000000201030001000000080000000301030001000000010000000601030001000000010000001101040001"
        "000000920000001501030001000000010000001601040001000000020000001701040001000000080000003d010300010000000200000053010300010000000100000000000000fa0a01ff"
        "00010203"
    ),
    ("tiff", "int16_strip"): (
        "49492a00080000000a000001040001000000030000000101040001000000010000000201030001000000100000000301030001000000010000000601030001000000010000001101040001"
        "00000086000000150103000100000001000000160104000100000001000000170104000100000006000000530103000100000002000000000000000080ffffff7f"
    ),
    ("tiff", "float64_strip"): (
        "49492a00080000000a000001040001000000020000000101040001000000010000000201030001000000400000000301030001000000010000000601030001000000010000001101040001"
        "0000008600000015010300010000000100000016010400010000000100000017010400010000001000000053010300010000000300000000000000000000000000f8bf59f3f8c21f6ea501"
    ),
    ("tiff", "jpeg_strip"): (
        "49492a00080000000a000001040001000000080000000101040001000000080000000201030001000000080000000301030001000000070000000601030001000000010000001101040001"
        "0000008600000015010300010000000100000016010400010000000800000017010400010000008e00000053010300010000000100000000000000ffd8ffdb004300010101010101010101"
        "01010101010101010101010101010101010101010101010101010101010101010101010101010101010101010101010101010101010101ffc0000b080008000801011100ffc40014000001"
        "00000000000000000000000000000affc40014100001000000000000000000000000000000ffda0008010100003f002403ffd9"
    ),
    ("raw", "raw"): (
        "7b226669656c6473223a207b22696d6167655769647468223a202233222c2022696d616765486569676874223a202232222c202274696c655769647468223a202232222c202274696c6548"
        "6569676874223a202232227d7d0102030405060708"
    ),
    ("pds4", "pds4"): (
        "a3000000000000003c50726f647563745f4f62736572766174696f6e616c3e3c41727261795f32445f496d6167653e3c696d6167654865696768743e313c2f696d6167654865696768743e"
        "3c696d61676557696474683e323c2f696d61676557696474683e3c706978656c547970653e55496e7431363c2f706978656c547970653e3c2f41727261795f32445f496d6167653e3c2f50"
        "726f647563745f4f62736572766174696f6e616c3e05005802"
    ),
    ("isis", "isis"): (
        "4f626a656374203d2049736973437562650a20204f626a656374203d20436f72650a2020202047726f7570203d2044696d656e73696f6e730a20202020202053616d706c6573203d20320a"
        "2020202020204c696e6573203d20320a20202020202042616e6473203d20310a20202020456e645f47726f75700a2020202047726f7570203d20506978656c730a20202020202054797065"
        "203d20556e7369676e6564427974650a20202020456e645f47726f75700a2020456e645f4f626a6563740a456e645f4f626a6563740a456e640a0b0c0d0e"
    ),
    ("chunked", "chunked"): (
        "40000000000000007b227368617065223a5b312c345d2c226368756e6b73223a5b312c325d2c226474797065223a223c7532222c22636f6d70726573736f72223a226e6f6e65227d040000"
        "0001000200040000000300ffff"
    ),
    ("exr", "exr"): (
        "762f3101020000006368616e6e656c730063686c69737400370000004200000000000000000001000000010000004700000000000000000001000000010000005200000000000000000001"
        "0000000100000000636f6d7072657373696f6e00636f6d7072657373696f6e0001000000006461746157696e646f7700626f78326900100000000000000000000000010000000000000064"
        "6973706c617957696e646f7700626f7832690010000000000000000000000001000000000000006c696e654f72646572006c696e654f72646572000100000000706978656c417370656374"
        "526174696f00666c6f617400040000000000803f73637265656e57696e646f7743656e746572007632660008000000000000000000000073637265656e57696e646f77576964746800666c"
        "6f617400040000000000803f00410100000000000000000000180000001e0000001f00000014000000150000000a0000000b000000"
    ),
}

# Of each tile: container, name, image size, sample type, channels, compression, tile number, samples.
TILES = [
    ("tiff", "big_endian_strips", 2, 2, "UInt16", 1, "None", 0, "01000200"),
    ("tiff", "big_endian_strips", 2, 2, "UInt16", 1, "None", 1, "2C01FFFF"),
    ("tiff", "big_tiff_tiles", 3, 1, "UInt8", 1, "None", 0, "0908"),
    ("tiff", "big_tiff_tiles", 3, 1, "UInt8", 1, "None", 1, "0700"),
    ("tiff", "lzw_strip", 9, 1, "UInt8", 1, "LZW", 0, "070707080807070606"),
    ("tiff", "packbits_strip", 24, 1, "UInt8", 1, "PackBits", 0, "AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA"),
    ("tiff", "deflate_strip", 4, 3, "UInt8", 1, "Deflate", 0, "0102030405060708090A0B0C"),
    ("tiff", "predictor_strip", 4, 2, "UInt8", 1, "None", 0, "FA04050400010306"),
    ("tiff", "int16_strip", 3, 1, "Int16", 1, "None", 0, "0080FFFFFF7F"),
    ("tiff", "float64_strip", 2, 1, "Float64", 1, "None", 0, "000000000000F8BF59F3F8C21F6EA501"),
    ("tiff", "jpeg_strip", 8, 8, "UInt8", 1, "Jpeg", 0, "C8" * 64),
    ("raw", "raw", 3, 2, "UInt8", 1, "None", 0, "01020304"),
    ("raw", "raw", 3, 2, "UInt8", 1, "None", 1, "05060708"),
    ("pds4", "pds4", 2, 1, "UInt16", 1, "None", 0, "05005802"),
    ("isis", "isis", 2, 2, "UInt8", 1, "None", 0, "0B0C0D0E"),
    ("chunked", "chunked", 4, 1, "UInt16", 1, "None", 0, "01000200"),
    ("chunked", "chunked", 4, 1, "UInt16", 1, "None", 1, "0300FFFF"),
    ("exr", "exr", 2, 1, "UInt32", 3, "None", 0, "0A000000140000001E0000000B000000150000001F000000"),
]
